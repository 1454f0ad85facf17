"""Entity resolution: mentions to clusters, similar names, canonical names, ids and resolved relationships.

Names whose similarity reaches a threshold t above one half either share 2t - 1 of their key tokens or one has all of the other's. So one of
the rarest tokens of one of them, as many as may be missing and one more, is a token of the other: pairs come from an equi-join of these few with
all tokens, and are scored exactly. A token that many names have is joined only for names that have no rarer one, and nothing above the threshold is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import names
from lodestack.operators.components import components
from lodestack.runtime import cut


def prepared(df: DataFrame, name: str = "name") -> DataFrame:
    """The rows plus norm, tokens and grams of their names."""
    df = df.withColumn("norm", names.normalize_name(F.col(name)))
    return df.withColumns({"tokens": names.key_tokens(F.col("norm")), "grams": names.trigrams(F.col("norm"))})


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{x}_{c}") for c in df.columns])


def _score() -> Column:
    return names.similarity(*[F.col(f"{x}_{c}") for c in ("norm", "tokens", "grams") for x in ("l", "r")])


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id", F.explode("tokens").alias("token"), *(["kind"] if "kind" in df.columns else []))


def _rarest(ours: DataFrame, all_tokens: DataFrame, by: list[str], least: float) -> DataFrame:
    """Of each id's tokens the rarest among all, as many as a name alike by `least` may lack and one more."""
    often = all_tokens.groupBy(*by).agg(F.count("*").alias("often"))
    own = Window.partitionBy("id")
    ranked = ours.join(often, by, "left").withColumns({"rank": F.row_number().over(own.orderBy(F.coalesce("often", F.lit(0)), "token")), "size": F.count("*").over(own)})
    # Rounding in the score must not cost a token.
    return ranked.where(F.col("rank") <= F.col("size") - F.ceil((2 * least - 1) * F.col("size") - 1e-4) + 1).drop("often", "rank", "size")


def blocked_pairs(reps: DataFrame, least: float) -> DataFrame:
    """l_id < r_id and score of representatives (id, kind, name) of one kind that score at least `least` (above 0.5).

    Token rows carry ids only; names join the distinct pairs afterwards.
    """
    p = prepared(reps.select("id", "kind", "name"))
    t = _ids(p)
    rare = _rarest(t, t, ["kind", "token"], least)
    met = rare.select("kind", "token", F.col("id").alias("x")).join(t.select("kind", "token", F.col("id").alias("y")), ["kind", "token"]).where("x <> y")
    pairs = met.select(F.least("x", "y").alias("l_id"), F.greatest("x", "y").alias("r_id")).distinct()
    q = p.drop("kind", "name")
    return pairs.join(_side(q, "l"), "l_id").join(_side(q, "r"), "r_id").select("l_id", "r_id", F.round(_score(), 6).alias("score")).where(F.col("score") >= least)


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, score of names of one frame with names of another (columns name), by shared tokens."""
    a, b = prepared(left.select("name").distinct()), prepared(right.select("name").distinct())
    ta, tb = (x.select(F.col("name").alias("id"), F.explode("tokens").alias("token")) for x in (a, b))
    l, r = F.col("id").alias("l_name"), F.col("id").alias("r_name")
    pairs = _rarest(ta, tb, ["token"], least).select("token", l).join(tb.select("token", r), "token").union(ta.select("token", l).join(_rarest(tb, ta, ["token"], least).select("token", r), "token").select("token", "l_name", "r_name")).select("l_name", "r_name").distinct()
    return pairs.join(_side(a, "l"), "l_name").join(_side(b, "r"), "r_name").select(F.col("l_name").alias("a"), F.col("r_name").alias("b"), F.round(_score(), 6).alias("score")).where(F.col("score") >= least)


def buckets(mentions: DataFrame) -> DataFrame:
    """Per (kind, normal form): the representative name and the counts. mentions: kind, name, artifact_id, confidence.

    Mentions below the least confidence or without a normal form are left out. The representative is the most frequent spelling; then that of
    fewest words, the shortest, the first by lower case, the first.
    """
    kept = mentions.where(F.col("confidence") >= names.LEAST_CONFIDENCE).withColumn("norm", names.normalize_name(F.col("name"))).where("norm <> ''")
    forms = kept.groupBy("kind", "norm", "name").agg(F.count("*").alias("n"))
    order = F.struct(-F.col("n"), F.size(F.split(F.trim("name"), r"\s+")).alias("w"), F.length("name").alias("l"), F.lower("name").alias("c"), F.col("name").alias("x"))
    return forms.groupBy("kind", "norm").agg(F.min_by("name", order).alias("name"), F.sum("n").alias("mentions")).withColumn("id", F.concat_ws("|", "kind", "norm"))


def clusters(mentions: DataFrame) -> DataFrame:
    """id (the bucket), kind, cluster (its least bucket): buckets of one kind merged over similar names, single linkage, and the cluster's cohesion (weakest link, 1 without)."""
    b = buckets(mentions)
    edges = blocked_pairs(b, names.MERGE)
    c = components(edges.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))).withColumnRenamed("node", "id")
    placed = b.join(c, "id", "left").withColumn("cluster", F.coalesce("component", "id")).select("id", "kind", "norm", "name", "mentions", "cluster")
    weakest = edges.join(c.select(F.col("id").alias("l_id"), F.col("component").alias("cluster")), "l_id").groupBy("cluster").agg(F.min("score").alias("weakest"))
    return placed.join(weakest, "cluster", "left").withColumn("cohesion", F.round(F.coalesce("weakest", F.lit(1.0)), 3)).drop("weakest")


def cluster_report(mentions: DataFrame, placed: DataFrame) -> DataFrame:
    """Per cluster: kind, canonical name, documents, mentions, mean confidence (summed in whole ten-thousandths, so alike in any order), cohesion. The canonical name is chosen as in buckets, over all mentions."""
    kept = mentions.where(F.col("confidence") >= names.LEAST_CONFIDENCE).withColumn("norm", names.normalize_name(F.col("name"))).where("norm <> ''")
    m = kept.join(placed.select("kind", "norm", "cluster", "cohesion"), ["kind", "norm"])
    spell = m.groupBy("cluster", "name").agg(F.count("*").alias("n"))
    order = F.struct(-F.col("n"), F.size(F.split(F.trim("name"), r"\s+")).alias("w"), F.length("name").alias("l"), F.lower("name").alias("c"), F.col("name").alias("x"))
    best = spell.groupBy("cluster").agg(F.min_by("name", order).alias("canonical_name"))
    counts = m.groupBy("cluster", "kind", "cohesion").agg(F.count_distinct("artifact_id").alias("documents"), F.count("*").alias("mentions"), F.round(F.sum(F.round(F.col("confidence") * 10_000).cast("long")) / F.count("*") / 10_000, 6).alias("mean_confidence"))
    return counts.join(best, "cluster")


def with_ids(report: DataFrame) -> DataFrame:
    """Object ids in cluster order (documents, mentions, name): type_name, with _2, _3 … where several clusters make the same."""
    base = names.object_id(F.col("kind"), F.col("canonical_name"))
    n = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("documents"), F.desc("mentions"), F.lower("canonical_name"), "cluster"))
    return report.withColumn("base", base).withColumn("n", n).withColumn("object_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string")))).drop("base", "n")


def cross_kind(reps: DataFrame) -> DataFrame:
    """Representatives with the same normal form and different kinds: norm, l_kind < r_kind."""
    b = reps.select("norm", "kind").distinct()
    return b.select("norm", F.col("kind").alias("l_kind")).join(b.select("norm", F.col("kind").alias("r_kind")), "norm").where("l_kind < r_kind")


def resolved_ends(ends: DataFrame, surface: DataFrame, least: float = names.MERGE) -> DataFrame:
    """norm and object_id of ends (column name): by equal normal form, else the most similar surface from `least` on; the least object_id on ties.

    Only the distinct ends without an equal form are compared.
    """
    known = surface.where("norm <> ''").groupBy("norm").agg(F.min("object_id").alias("object_id"))
    asked = ends.select(names.normalize_name(F.col("name")).alias("norm")).where("norm <> ''").distinct()
    exact = asked.join(known, "norm").select("norm", "object_id")
    open_ = cut(asked.join(known, "norm", "left_anti").select(F.col("norm").alias("name")))
    if open_.isEmpty():
        return exact
    near = similar_pairs(open_, known.select(F.col("norm").alias("name")), least).join(known.withColumnRenamed("norm", "b"), "b")
    best = near.groupBy(F.col("a").alias("norm")).agg(F.min_by("object_id", F.struct(-F.col("score"), F.col("object_id"))).alias("object_id"))
    return exact.unionByName(best)


def resolve_relationships(raw: DataFrame, surface: DataFrame) -> DataFrame:
    """Triples of objects out of raw (subject, predicate, object, confidence, quote, seq) by surface (norm, object_id): best confidence, and the first three quotes by seq.

    Ends are known by their normal form or by a similar one. Rows with an end that is not known, or both ends on one object, are left out.
    """
    known = resolved_ends(raw.select(F.col("subject").alias("name")).union(raw.select("object")), surface)
    s = raw.withColumn("norm", names.normalize_name(F.col("subject"))).join(known.withColumnRenamed("object_id", "source"), "norm").drop("norm")
    o = s.withColumn("norm", names.normalize_name(F.col("object"))).join(known.withColumnRenamed("object_id", "target"), "norm").where("source <> target")
    # Three least by place, kept while combining, so a triple said a million times gathers three quotes.
    ranked = o.withColumn("r", F.row_number().over(Window.partitionBy("source", "predicate", "target").orderBy("seq")))
    return ranked.groupBy("source", "predicate", "target").agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("said"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("seq", "quote")))), lambda x: x["quote"]), " | ").alias("quotes")
    )


def linked_pairs(triples: DataFrame) -> DataFrame:
    """Unordered pairs that more than one predicate ties: lo, hi, predicates."""
    p = triples.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), "predicate").distinct()
    return p.groupBy("lo", "hi").agg(F.count("*").alias("predicates")).where("predicates > 1")
