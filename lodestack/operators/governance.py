"""Governance reports: quality from six factors, health, orphans, domains, alerts. Joins and combining aggregates only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.measures import saturated

# What a review state counts for, the weights of the six factors, and the evidence that counts in full.
REVIEW_WEIGHT = {"APPROVED": 1.0, "NEEDS_ATTENTION": 0.5, "PENDING_REVIEW": 0.4, "ARCHIVED": 0.2, "REJECTED": 0.0}
WEIGHTS = {"evidence_score": 0.20, "review_score": 0.20, "freshness_score": 0.15, "consistency_score": 0.15, "owner_score": 0.10, "confidence_score": 0.20}
TARGET_EVIDENCE = 5
OPEN_STATES = ["PENDING_REVIEW", "NEEDS_ATTENTION"]


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))


def quality(objects: DataFrame) -> DataFrame:
    """object_id, the six factors (0 to 1) and quality_score (0 to 100).

    objects: object_id, evidence_count, review_state, freshness_score, relationship_total, relationship_rejected, has_owner, confidence. NULL counts and confidence are 0, a NULL
    freshness is 1, an unknown review state counts as one that is due, an object without relationships is consistent.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    state = F.create_map(*[F.lit(x) for kv in REVIEW_WEIGHT.items() for x in kv])
    factors = {
        "evidence_score": saturated(zero("evidence_count"), TARGET_EVIDENCE),
        "review_score": F.coalesce(F.try_element_at(state, F.col("review_state")), F.lit(REVIEW_WEIGHT["PENDING_REVIEW"])),
        "freshness_score": _unit(F.coalesce("freshness_score", F.lit(1.0))),
        "consistency_score": _unit(F.when(zero("relationship_total") > 0, 1 - zero("relationship_rejected") / F.col("relationship_total")).otherwise(1.0)),
        "owner_score": F.when(F.col("has_owner"), 1.0).otherwise(0.0),
        "confidence_score": _unit(F.coalesce("confidence", F.lit(0.0))),
    }
    blend = reduce(lambda a, b: a + b, [WEIGHTS[k] * v for k, v in factors.items()]) / sum(WEIGHTS.values())
    # The sum may fall short of a half by what floats leave out.
    return objects.select("object_id", *[F.round(v, 3).alias(k) for k, v in factors.items()], F.round(F.round(blend * 100, 6), 1).alias("quality_score"))


def quality_inputs(objects: DataFrame, evidence: DataFrame, edges: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """What `quality` reads, out of objects (id, confidence), evidence (object_id), edges (source, target, review_status) and lifecycle (object_id, review_state, freshness_score, owner)."""
    e = evidence.groupBy("object_id").agg(F.count("*").alias("evidence_count"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("object_id"), "review_status").groupBy("object_id").agg(F.count("*").alias("relationship_total"), F.count_if(F.col("review_status") == "REJECTED").alias("relationship_rejected"))
    o = objects.select(F.col("id").alias("object_id"), "confidence")
    life = lifecycle.select("object_id", "review_state", "freshness_score", F.col("owner").isNotNull().alias("has_owner"))
    return o.join(e, "object_id", "left").join(ends, "object_id", "left").join(life, "object_id", "left")


def domain_health(members: DataFrame, scores: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """domain, object_count, avg_quality, avg_freshness, review_backlog. members: object_id, domain. Averages of none are 0."""
    m = members.where(F.trim("domain") != "").select("object_id", F.trim("domain").alias("domain")).distinct()
    j = m.join(scores.select("object_id", "quality_score"), "object_id", "left").join(lifecycle.select("object_id", "freshness_score", "review_state"), "object_id", "left")
    # Scores have three decimals at most: summed as whole numbers, they are the same in any order.
    mean = lambda c, n: F.round(F.coalesce(F.sum(F.round(F.col(c) * 1000).cast("long")) / F.count(c) / 1000, F.lit(0.0)), n)
    return j.groupBy("domain").agg(F.count("*").alias("object_count"), mean("quality_score", 1).alias("avg_quality"), mean("freshness_score", 3).alias("avg_freshness"), F.count_if(F.col("review_state").isin(OPEN_STATES)).alias("review_backlog"))


def has_payload(evidence: Column) -> Column:
    """Whether an evidence payload says something: JSON that isn't empty, or text that is no JSON and not blank."""
    empty = F.trim(evidence).isin("", "[]", "{}", "null", '""', "0", "false")
    return ~F.coalesce(empty, F.lit(True))


def orphans(objects: DataFrame, evidence: DataFrame, edges: DataFrame, owners: DataFrame) -> DataFrame:
    """report, id of every orphan: objects without evidence, without an edge that isn't rejected, without an owner, edges (not rejected) without evidence, evidence without its object.

    objects: id. evidence: id, object_id. edges: id, source, target, review_status, evidence. owners: object_id.
    """
    ids = objects.select(F.col("id").cast("string").alias("id"))
    live = edges.where("review_status <> 'REJECTED'")
    without = lambda name, having: ids.join(having, "id", "left_anti").select(F.lit(name).alias("report"), "id")
    out = without("objects_without_evidence", evidence.select(F.col("object_id").alias("id")))
    out = out.union(without("objects_without_relationships", live.select(F.explode(F.array("source", "target")).alias("id"))))
    out = out.union(without("objects_without_owner", owners.select(F.col("object_id").alias("id"))))
    out = out.union(live.where(~has_payload(F.col("evidence"))).select(F.lit("relationships_without_evidence"), F.col("id").cast("string")))
    lost = evidence.join(objects.select(F.col("id").alias("object_id")), "object_id", "left_anti")
    return out.union(lost.select(F.lit("evidence_without_object"), F.col("id").cast("string")))


def alerts(lifecycle: DataFrame, orphaned: DataFrame, conflicts: DataFrame, low_quality: DataFrame, now: Column, stale_days: int = 180) -> DataFrame:
    """alert_type, severity, object_id of the state of the store.

    lifecycle: object_id, freshness_state, review_state, reviewed_at (timestamp, NULL for never). orphaned: as `orphans` gives. conflicts, low_quality: object_id.
    """
    kind = lambda df, t, s, c="object_id": df.select(F.lit(t).alias("alert_type"), F.lit(s).alias("severity"), F.col(c).alias("object_id"))
    age = (F.unix_micros(now) - F.unix_micros("reviewed_at")) / 86_400_000_000
    out = [
        kind(lifecycle.where(F.col("freshness_state").isin("STALE", "ARCHIVED")), "STALE_KNOWLEDGE", "WARNING"),
        kind(lifecycle.where((F.col("review_state") == "APPROVED") & (age >= stale_days)), "STALE_REVIEW", "WARNING"),
        kind(orphaned.where("report = 'objects_without_relationships'"), "ORPHANED_OBJECT", "INFO", "id"),
        kind(orphaned.where("report = 'objects_without_evidence'"), "ORPHANED_OBJECT", "CRITICAL", "id"),
        kind(orphaned.where("report = 'objects_without_owner'"), "MISSING_OWNER", "INFO", "id"),
        kind(conflicts, "CONFLICTING_EVIDENCE", "WARNING"),
        kind(low_quality, "QUALITY_DEGRADATION", "WARNING"),
    ]
    return reduce(DataFrame.union, out)


def islands(components: DataFrame, vertices: DataFrame) -> DataFrame:
    """component and size of the connected parts of a graph, vertices without an edge being parts of their own. components: node, component."""
    v = vertices.select(F.col("id").alias("node")).join(components, "node", "left").select(F.coalesce("component", "node").alias("component"))
    return v.groupBy("component").agg(F.count("*").alias("size"))


def spending(usage: DataFrame, key: str) -> DataFrame:
    """key, calls, total_tokens, cost (NULL where no call is priced) and unpriced_calls. usage: the key's column, total_tokens, cost_hundredths (whole, so that sums are exact)."""
    cost = F.round(F.sum("cost_hundredths") / 100, 2)
    return usage.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), cost.alias("cost"), F.count_if(F.col("cost_hundredths").isNull()).alias("unpriced_calls"))
