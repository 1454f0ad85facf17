"""The consolidated store: structural edges, upserts that keep reviews, look-ups with display names.

Edges are frames of source, predicate, target, confidence, quote, seq (the order in which they were said). What is the case already
is excluded by anti-joins on unordered pairs, never by collecting pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import measures, names
from lodestack.operators.documents import clause_references
from lodestack.operators.resolution import resolved_ends
from lodestack.runtime import cut

EDGE = ["source", "predicate", "target", "confidence", "quote", "seq"]
#: Quotes that an edge keeps.
QUOTES = 3


def requirement_name(standard: Column, clause: Column, title: Column) -> Column:
    """What a requirement is called: standard and clause, else the clause, else the title."""
    return names.display_name((standard, clause), (clause,), (title,), otherwise="Requirement")


def equation_name(standard: Column, symbol: Column, clause: Column) -> Column:
    """What an equation is called: standard and symbol, else the symbol, standard and clause, the clause."""
    return names.display_name((standard, symbol), (symbol,), (standard, clause), (clause,), otherwise="Equation")


def _ends(edges: DataFrame, surface: DataFrame, similar: bool) -> DataFrame:
    """Edges between names as edges between objects; with similar, names that only look alike count too. Loops and unknown ends fall out."""
    asked = edges.select(F.col("from").alias("name")).union(edges.select("to"))
    known = surface.where("norm <> ''").groupBy("norm").agg(F.min("object_id").alias("object_id"))
    ends = resolved_ends(asked, surface) if similar else known
    side = lambda c, o: (ends.select(F.col("norm").alias(f"{c}_norm"), F.col("object_id").alias(o)), F.col(f"{c}_norm") == names.normalize_name(F.col(c)))
    (a, on_a), (b, on_b) = side("from", "source"), side("to", "target")
    return edges.join(a, on_a).join(b, on_b).where("source <> target").select(*EDGE)


def mandated_by(requirements: DataFrame, surface: DataFrame) -> DataFrame:
    """Each requirement's edge to its standard. requirements: standard_name, clause_ref, title, confidence, quote, seq. surface: norm, object_id."""
    r = requirements.where(F.trim("standard_name") != "")
    name = requirement_name(F.col("standard_name"), F.col("clause_ref"), F.col("title"))
    return _ends(r.select(name.alias("from"), F.trim("standard_name").alias("to"), F.lit("mandated_by").alias("predicate"), "confidence", "quote", "seq"), surface, True)


def of_equations(equations: DataFrame, surface: DataFrame) -> DataFrame:
    """An equation's edge to its standard (mandated_by), and that of the requirement on its clause to it (specifies). equations: standard_name, symbol, clause_ref, confidence, quote, seq."""
    e = equations.where(F.trim("standard_name") != "")
    name = equation_name(F.col("standard_name"), F.col("symbol"), F.col("clause_ref"))
    up = e.select(name.alias("from"), F.trim("standard_name").alias("to"), F.lit("mandated_by").alias("predicate"), "confidence", "quote", "seq")
    clause = requirement_name(F.col("standard_name"), F.col("clause_ref"), F.lit(None).cast("string"))
    return _ends(up.unionByName(e.where(F.trim("clause_ref") != "").select(clause.alias("from"), name.alias("to"), F.lit("specifies").alias("predicate"), "confidence", "quote", "seq")), surface, True)


def references(requirements: DataFrame, surface: DataFrame, standards: DataFrame) -> DataFrame:
    """Edges by what requirements' texts cite: a clause of the same standard, or another standard by its name. Names must be equal, not alike.

    requirements: standard_name, clause_ref, title, text, confidence, seq. standards: name, object_id. A standard's name is found by its first
    word among the text's, so that no text meets every standard, and then as a whole.
    """
    r = requirements.where(F.trim("standard_name") != "").withColumn("quote", F.col("text"))
    name = requirement_name(F.col("standard_name"), F.col("clause_ref"), F.col("title"))
    none = F.lit(None).cast("string")
    cited = r.withColumn("clause", F.explode(clause_references("text"))).where(F.col("clause") != F.trim(F.coalesce("clause_ref", F.lit(""))))
    to_clause = cited.select(name.alias("from"), requirement_name(F.col("standard_name"), F.col("clause"), none).alias("to"), F.lit("references").alias("predicate"), "confidence", "quote", "seq")
    words = lambda c: F.filter(F.split(measures.designation(F.col(c)), r"(?U)[^\w]+"), lambda w: w != "")
    known = standards.select(F.col("name").alias("to"), words("name").alias("w")).where(F.size("w") > 0).select("to", F.col("w")[0].alias("word"))
    said = r.select("standard_name", "text", "confidence", "quote", "seq", F.explode(F.array_distinct(words("text"))).alias("word"))
    to_standard = said.join(known, "word").where(measures.mentions(F.col("text"), F.col("to")) & (names.normalize_name(F.col("to")) != names.normalize_name(F.col("standard_name"))))
    to_standard = to_standard.select(F.trim("standard_name").alias("from"), "to", F.lit("references").alias("predicate"), "confidence", "quote", "seq")
    return _ends(to_clause, surface, False).unionByName(_ends(to_standard, standards.select(names.normalize_name(F.col("name")).alias("norm"), "object_id"), False)).distinct()


def appears_in(mentions: DataFrame) -> DataFrame:
    """An edge of every object to each standard with which it shares a document, with its surest mention there. mentions: object_id, object_type, artifact_id, confidence, quote, seq."""
    there = mentions.where("object_type = 'Standard'").select("artifact_id", F.col("object_id").alias("target")).distinct()
    surest = mentions.where("object_type <> 'Standard'").groupBy("object_id", "artifact_id").agg(F.max_by(F.struct("confidence", "quote", "seq"), F.struct("confidence", -F.col("seq"))).alias("x"))
    met = surest.join(there, "artifact_id").where("object_id <> target")
    one = met.groupBy(F.col("object_id").alias("source"), "target").agg(F.max_by("x", F.struct("x.confidence", -F.col("x.seq"))).alias("x"))
    return one.select("source", F.lit("appears_in").alias("predicate"), "target", "x.confidence", "x.quote", "x.seq")


def _pair() -> list[Column]:
    return [F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")]


def unless_linked(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The edges whose pair of objects no known edge ties, in either direction."""
    tied = known.select(*_pair()).distinct()
    return edges.withColumns({c: x for c, x in zip(("lo", "hi"), _pair(), strict=True)}).join(tied, ["lo", "hi"], "left_anti").drop("lo", "hi")


def gathered(edges: DataFrame) -> DataFrame:
    """source, predicate, target with the best confidence (NULL is 0), how often it was said, and the first quotes by seq that aren't blank."""
    e = cut(edges).withColumn("q", F.when(F.trim(F.coalesce("quote", F.lit(""))) != "", F.struct("seq", F.trim("quote").alias("quote"))))
    # Of each edge the least few quotes, kept while they are combined.
    ranked = e.groupBy("source", "predicate", "target").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.count("*").alias("said"), F.min("q").alias("q0"))
    rest, at = e.select("source", "predicate", "target", "q").where("q IS NOT NULL"), "q0"
    for k in range(1, QUOTES):
        before = ranked.select("source", "predicate", "target", F.col(at).alias("b"))
        rest = rest.join(before, ["source", "predicate", "target"]).where(F.col("q") > F.col("b")).drop("b")
        ranked, at = ranked.join(rest.groupBy("source", "predicate", "target").agg(F.min("q").alias(f"q{k}")), ["source", "predicate", "target"], "left"), f"q{k}"
    quotes = F.transform(F.array_compact(F.array(*[f"q{k}" for k in range(QUOTES)])), lambda x: x["quote"])
    return ranked.select("source", "predicate", "target", "confidence", "said", F.array_join(quotes, " | ").alias("quotes"))


def consolidated(said: DataFrame, structural: list[DataFrame], crossing: DataFrame, containing: DataFrame) -> DataFrame:
    """All edges of a run: those said and the structural ones first, cross-references between pairs these leave untied, then containment between pairs still untied."""
    first = cut(reduce(DataFrame.unionByName, [x.select(*EDGE) for x in (said, *structural)]))
    second = cut(first.unionByName(unless_linked(crossing, first).select(*EDGE)))
    return gathered(second.unionByName(unless_linked(containing, second).select(*EDGE)))


def with_kept_reviews(edges: DataFrame, reviews: DataFrame, fresh: str = "PENDING_REVIEW") -> DataFrame:
    """The edges with review_status: what a reviewer said of the same edge before (source, predicate, target, review_status), else fresh."""
    kept = reviews.where(F.col("review_status") != fresh).groupBy("source", "predicate", "target").agg(F.max("review_status").alias("review_status"))
    return edges.join(kept, ["source", "predicate", "target"], "left").withColumn("review_status", F.coalesce("review_status", F.lit(fresh)))


def between(rows: DataFrame, low: float, high: float, **equal: str) -> DataFrame:
    """Rows of a confidence within the bounds, both included, whose other columns have the given values."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), equal.items(), rows.where(F.col("confidence").between(low, high)))


def approved_edges(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Approved edges whose two ends are approved. edges: …, review_status; objects: id, status."""
    ok = objects.where("status = 'APPROVED'").select("id")
    e = edges.where("review_status = 'APPROVED'")
    return e.join(ok.select(F.col("id").alias("source")), "source", "left_semi").join(ok.select(F.col("id").alias("target")), "target", "left_semi")


def touching(edges: DataFrame, objects: DataFrame, object_id: str) -> DataFrame:
    """The edges of one object with the names of both ends; an end that is no object keeps its id."""
    label = objects.select("id", "name")
    e = edges.where((F.col("source") == object_id) | (F.col("target") == object_id))
    e = e.join(label.select(F.col("id").alias("source"), F.col("name").alias("source_name")), "source", "left").join(label.select(F.col("id").alias("target"), F.col("name").alias("target_name")), "target", "left")
    return e.withColumns({"source_name": F.coalesce("source_name", "source"), "target_name": F.coalesce("target_name", "target")})
