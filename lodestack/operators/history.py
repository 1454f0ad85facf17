"""Snapshots and logs of knowledge: drift, replays of change logs, alternations of review states, orphans and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drift(previous: DataFrame, current: DataFrame, established: int = 5, drop: float = 0.5) -> DataFrame:
    """kind, object_id, related_id of the differences of two snapshots (object_id, object_type, document_count).

    removed: an object in at least `established` documents is gone. terminology_change: such an object and a new one of its type.
    disappearing_evidence: documents fell to at most `drop` of what they were.
    """
    p = previous.select("object_id", F.col("object_type").alias("t0"), F.col("document_count").alias("n0"))
    c = current.select("object_id", F.col("object_type").alias("t1"), F.col("document_count").alias("n1"))
    j = p.join(c, "object_id", "full")
    gone = j.where(F.col("n1").isNull() & F.col("t1").isNull() & (F.col("n0") >= established)).select("object_id", F.col("t0").alias("t"))
    new = j.where(F.col("n0").isNull() & F.col("t0").isNull()).select(F.col("object_id").alias("related_id"), F.col("t1").alias("t"))
    fell = j.where((F.col("n0") > 0) & (F.col("n1") < F.col("n0")) & (F.col("n1") / F.col("n0") <= drop))
    kind = lambda k: F.lit(k).alias("kind")
    out = gone.select(kind("removed"), "object_id", F.lit("").alias("related_id"))
    out = out.union(gone.join(new, "t").select(kind("terminology_change"), "object_id", "related_id"))
    return out.union(fell.select(kind("disappearing_evidence"), "object_id", F.lit("").alias("related_id")))


def changed_triples(known: DataFrame, current: DataFrame) -> DataFrame:
    """source, predicate, target, change of the triples in one of two sets only: added ones are new, removed ones are gone. Copies count once."""
    k, c = known.select("source", "predicate", "target"), current.select("source", "predicate", "target")
    return c.subtract(k).withColumn("change", F.lit("added")).union(k.subtract(c).withColumn("change", F.lit("removed")))


def replay(log: DataFrame, key: list[str], added: str) -> DataFrame:
    """Keys whose last entry in the log (seq, kind, key columns) is an addition."""
    return log.groupBy(*key).agg(F.max_by("kind", "seq").alias("last")).where(F.col("last") == added).select(*key)


def before_last(reviews: DataFrame) -> DataFrame:
    """target, now, before: the state of each target's last review and the one it replaced (NULL for the first)."""
    w = Window.partitionBy("target").orderBy("seq")
    r = reviews.withColumns({"before": F.lag("action").over(w), "back": F.row_number().over(Window.partitionBy("target").orderBy(F.desc("seq")))})
    return r.where("back = 1").select("target", F.col("action").alias("now"), "before")


def conflicts(evidence: DataFrame, high: float, low: float) -> DataFrame:
    """object_id, best, worst, n where the best evidence reaches high and the worst is at most low."""
    g = evidence.groupBy("object_id").agg(F.max("confidence").alias("best"), F.min("confidence").alias("worst"), F.count("*").alias("n"))
    return g.where((F.col("best") >= high) & (F.col("worst") <= low))


def most_connected(vertices: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """id, degree of the most tied vertices: the first `limit` by degree and id, of those the tied."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    out = vertices.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return out.orderBy(F.desc("degree"), "id").limit(limit).where("degree > 0")


def end_counts(edges: DataFrame, rejected: str) -> DataFrame:
    """id, total, rejected: edges at each vertex and those a condition rejects. A self-loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), F.expr(rejected).alias("r"))
    return ends.groupBy("id").agg(F.count("*").alias("total"), F.count_if("r").alias("rejected"))


def unlinked(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return vertices.join(ends, "id", "left_anti").select("id")
