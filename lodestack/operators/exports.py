"""Graphs and reports as files: JSON, CSV, N-Triples, GraphML and GEXF."""

from __future__ import annotations

from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows one XML file holds at most; it is written by the driver, row by row, for viewers that read nothing else.
MOST_XML_ROWS = 1_000_000
BASE = "https://kg.example/"


def _term(c: Column) -> Column:
    return F.concat(F.lit(f"<{BASE}"), F.regexp_replace(c, r"[\s<>\"{}|^`\\]", "_"), F.lit(">"))


def _literal(c: Column) -> Column:
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def n_triples(triples: DataFrame, literals: list[str]) -> DataFrame:
    """One column value: a line for each triple (s, p, o); objects of the named predicates are literals."""
    o = F.when(F.col("p").isin(*literals), _literal(F.col("o"))).otherwise(_term(F.col("o")))
    return triples.select(F.concat_ws(" ", _term(F.col("s")), _term(F.col("p")), o, F.lit(".")).alias("value"))


def turtle(triples: DataFrame, literals: list[str]) -> DataFrame:
    """One column value: each subject once, with its predicates and their objects in order. A subject's block is one row, so a subject with very many triples makes a long one."""
    o = F.when(F.col("p").isin(*literals), _literal(F.col("o"))).otherwise(_term(F.col("o")))
    by = triples.select("s", "p", o.alias("o")).distinct().groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("o"))
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", _term(F.col("p")), F.col("o")))), " ;\n    ")
    return by.groupBy("s").agg(lines.alias("x")).select(F.concat(_term(F.col("s")), F.lit(" "), F.col("x"), F.lit(" .")).alias("value"))


def json_ld(triples: DataFrame, literals: list[str]) -> DataFrame:
    """One column value: a JSON-LD node for each subject, one a line."""
    address = lambda c: F.concat(F.lit(BASE), F.regexp_replace(c, r"[\s<>\"{}|^`\\]", "_"))
    node = F.when(F.col("p").isin(*literals), F.to_json(F.struct(F.col("o").alias("@value")))).otherwise(F.to_json(F.struct(address(F.col("o")).alias("@id"))))
    by = triples.select("s", "p", node.alias("o")).distinct().groupBy("s", "p").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("o")), ","), F.lit("]")).alias("o"))
    name = F.to_json(F.array(address(F.col("p"))))
    entry = F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.col("o"))
    subject = F.to_json(F.struct(address(F.col("s")).alias("@id")))
    return by.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("x")).select(F.concat(F.substring(subject, F.lit(1), F.length(subject) - 1), F.lit(","), F.col("x"), F.lit("}")).alias("value"))


def node_link(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """part (nodes or links) and value: a JSON object for each node and each link of a viewer's graph."""
    n = vertices.select(F.lit("nodes").alias("part"), F.to_json(F.struct("id", "label", F.col("kind").alias("type"))).alias("value"))
    return n.union(edges.select(F.lit("links"), F.to_json(F.struct("source", "target", "predicate"))))


def write_node_link(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Both parts as folders of JSON lines."""
    node_link(vertices, edges).write.mode("overwrite").partitionBy("part").text(path)


def write_n_triples(triples: DataFrame, path: str, literals: list[str]) -> None:
    n_triples(triples, literals).write.mode("overwrite").text(path)


def check_n_triples(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines, and those that are no triple."""
    line = r'^<[^<>\s]+> <[^<>\s]+> (<[^<>\s]+>|"([^"\\]|\\.)*") \.$'
    return spark.read.text(path).agg(F.count("*").alias("triples"), F.count_if(~F.col("value").rlike(line)).alias("malformed"))


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted over all partitions; the part files in order are the sorted whole."""
    df.orderBy(*order).write.mode("overwrite").option("header", "true").csv(path)


def _rows(df: DataFrame):  # noqa: ANN202
    if df.count() > MOST_XML_ROWS:
        raise ValueError(f"more than {MOST_XML_ROWS} rows for one XML file")
    return df.toLocalIterator()


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    with Path(path).open("w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for k, on in (("kind", "node"), ("label", "node"), ("predicate", "edge")):
            f.write(f'<key id="{k}" for="{on}" attr.name="{k}" attr.type="string"/>\n')
        f.write('<graph edgedefault="directed">\n')
        for v in _rows(vertices.select("id", "kind", "label").orderBy("id")):
            f.write(f"<node id={quoteattr(v.id)}>" + "".join(f'<data key="{k}">{quoteattr(str(x))[1:-1]}</data>' for k, x in (("kind", v.kind), ("label", v.label)) if x is not None) + "</node>\n")
        for e in _rows(edges.select("source", "target", "predicate").orderBy("source", "target", "predicate")):
            f.write(f'<edge source={quoteattr(e.source)} target={quoteattr(e.target)}><data key="predicate">{quoteattr(str(e.predicate))[1:-1]}</data></edge>\n')
        f.write("</graph>\n</graphml>\n")


def write_gexf(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    with Path(path).open("w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<graph defaultedgetype="directed">\n<nodes>\n')
        for v in _rows(vertices.select("id", "label").orderBy("id")):
            f.write(f"<node id={quoteattr(v.id)} label={quoteattr(str(v.label))}/>\n")
        f.write("</nodes>\n<edges>\n")
        for i, e in enumerate(_rows(edges.select("source", "target", "predicate").orderBy("source", "target", "predicate"))):
            f.write(f'<edge id="{i}" source={quoteattr(e.source)} target={quoteattr(e.target)} label={quoteattr(str(e.predicate))}/>\n')
        f.write("</edges>\n</graph>\n</gexf>\n")
