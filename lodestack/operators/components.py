"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import cut


def _least(sym: DataFrame) -> DataFrame:
    return sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return sym.where("b > a").join(_least(sym), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. Edges have a > b."""
    m = _least(edges)
    return edges.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m).where("a != b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its least node) for every node that an edge (a, b) touches.

    NULL ends are ignored, a self-loop is a component of one, repeated edges count once, no edges give no rows. Ends may be of any
    ordered type. Each round joins nodes to the least of their neighbours, found by a combining aggregate, so a hub is never
    gathered in one task; a round's edges go to the checkpoint folder.
    """
    known = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = known.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = cut(known.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen[0] == 0 or tuple(seen) == was:
            break
        was = tuple(seen)
        now = cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).union(loops)
    return ends.groupBy("node").agg(F.min("component").alias("component"))
