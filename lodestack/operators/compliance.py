"""Assessments of requirements by controls, with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import times


def coverage(assessments: DataFrame, group: list[str]) -> DataFrame:
    """Per group: distinct requirements, those with an approved SATISFIED and with an approved PARTIAL assessment, and the shares."""
    ok = F.col("review_status") == "APPROVED"
    req = F.col("requirement_object_id")
    out = assessments.groupBy(*group).agg(
        F.count_distinct(req).alias("requirements"),
        F.count_distinct(F.when(ok & (F.col("status") == "SATISFIED"), req)).alias("satisfied"),
        F.count_distinct(F.when(ok & (F.col("status") == "PARTIAL"), req)).alias("partial"),
    )
    return out.withColumn("coverage", F.round(F.coalesce(F.try_divide(F.col("satisfied"), F.col("requirements")), F.lit(0.0)), 4))


def open_gaps(assessments: DataFrame) -> DataFrame:
    """Requirements no approved assessment satisfies."""
    met = assessments.where("review_status = 'APPROVED' AND status = 'SATISFIED'").select("requirement_object_id")
    return assessments.select("requirement_object_id").where("requirement_object_id IS NOT NULL").distinct().join(met, "requirement_object_id", "left_anti")


def strongest_status(assessments: DataFrame, rank: dict[str, int]) -> DataFrame:
    """Per requirement the approved status of the highest rank; the first by assessment id on ties."""
    r = F.coalesce(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("status")], F.lit(0))
    ok = assessments.where("review_status = 'APPROVED'").withColumn("r", r)
    return ok.groupBy("requirement_object_id").agg(F.max_by("status", F.struct(F.col("r"), -F.col("id"))).alias("status"))


def evidence_summary(evidence: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """Per assessment: quotes that aren't blank, artifacts, the best confidence, and the age in days of the newest quote whose time can be read (NULL: none)."""
    real = evidence.where(F.trim(F.coalesce("quote", F.lit(""))) != "").withColumn("age", (F.unix_micros(now) - F.unix_micros(times.moment(F.col("created_at")))) / 86_400_000_000)
    return real.groupBy("assessment_id").agg(F.count("*").alias("quotes"), F.count_distinct("artifact_id").alias("artifacts"), F.max("confidence").alias("best"), F.round(F.min("age"), 3).alias("newest_age"))


def derived_status(assessments: DataFrame, summary: DataFrame, stale_days: float = 365.0) -> DataFrame:
    """What the evidence says: GAP without quotes, PARTIAL when not approved or the newest quote is older than stale_days, else SATISFIED."""
    j = assessments.join(summary, assessments["id"] == summary["assessment_id"], "left")
    status = F.when(F.coalesce("quotes", F.lit(0)) == 0, "GAP").when(~F.col("review_status").eqNullSafe("APPROVED"), "PARTIAL").when(F.col("newest_age") > stale_days, "PARTIAL").otherwise("SATISFIED")
    return j.select("id", F.col("status").alias("stated"), status.alias("derived"))


def top_quotes(evidence: DataFrame, per: int, most: int | None = None) -> DataFrame:
    """The best quotes of each assessment by confidence (NULLs last), then id; with `most`, of those the first so many in the order of assessments."""
    r = F.row_number().over(Window.partitionBy("assessment_id").orderBy(F.desc_nulls_last("confidence"), "id"))
    out = evidence.where("assessment_id IS NOT NULL").select("assessment_id", "id", "confidence", r.alias("rank")).where(F.col("rank") <= per)
    return out.orderBy("assessment_id", "rank").limit(most) if most else out
