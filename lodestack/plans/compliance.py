"""Queries over assessments and their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import measures
from lodestack.operators import compliance as C
from lodestack.plans.catalog import NOW, moment_sql
from lodestack.plans.registry import Query
from lodestack.runtime import table

RANK = {"SATISFIED": 3, "PARTIAL": 2, "GAP": 1, "NOT_APPLICABLE": 1}
EVIDENCE = "e AS (SELECT DISTINCT * FROM compliance_assessment_evidence)"
SUMMARY = f"""{EVIDENCE}, s AS (SELECT assessment_id, count(*) AS quotes, count(DISTINCT artifact_id) AS artifacts, max(confidence) AS best,
  round(min((epoch_us(TIMESTAMP '2025-06-01') - epoch_us({moment_sql('created_at')})) / 86400000000), 3) AS newest_age FROM e WHERE trim(coalesce(quote, '')) <> '' GROUP BY 1)"""


def _a(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "compliance_assessments")


def _e(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "compliance_assessment_evidence").distinct()


def _standard(spark, d):  # noqa: ANN001, ANN202
    return _a(spark, d).withColumn("standard", F.regexp_replace("requirement_object_id", r"(_\d+)+$", ""))


def _summary(spark, d):  # noqa: ANN001, ANN202
    return C.evidence_summary(_e(spark, d), F.to_timestamp(F.lit(NOW)))


def _cov_sql(select: str, source: str, group: str) -> str:
    return f"""SELECT {select} count(DISTINCT requirement_object_id) AS requirements, count(DISTINCT requirement_object_id) FILTER (review_status = 'APPROVED' AND status = 'SATISFIED') AS satisfied,
count(DISTINCT requirement_object_id) FILTER (review_status = 'APPROVED' AND status = 'PARTIAL') AS partial,
round(coalesce(count(DISTINCT requirement_object_id) FILTER (review_status = 'APPROVED' AND status = 'SATISFIED') / nullif(count(DISTINCT requirement_object_id), 0), 0), 4) AS coverage FROM {source} {group}"""


QUERIES = {
    "comp_coverage": Query(lambda s, d: C.coverage(_a(s, d), []), _cov_sql("", "compliance_assessments", "")),
    "comp_coverage_by_standard": Query(
        lambda s, d: C.coverage(_standard(s, d), ["standard"]),
        _cov_sql("standard,", r"(SELECT *, regexp_replace(requirement_object_id, '(_\d+)+$', '') AS standard FROM compliance_assessments)", "GROUP BY standard"),
    ),
    "comp_gaps": Query(
        lambda s, d: C.open_gaps(_a(s, d)),
        """SELECT DISTINCT requirement_object_id FROM compliance_assessments a WHERE requirement_object_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM compliance_assessments b
WHERE b.requirement_object_id = a.requirement_object_id AND b.review_status = 'APPROVED' AND b.status = 'SATISFIED')""",
    ),
    "comp_strongest_status": Query(
        lambda s, d: C.strongest_status(_a(s, d), RANK),
        """SELECT requirement_object_id, status FROM (SELECT *, row_number() OVER (PARTITION BY requirement_object_id ORDER BY CASE status WHEN 'SATISFIED' THEN 3 WHEN 'PARTIAL' THEN 2 WHEN 'GAP' THEN 1
WHEN 'NOT_APPLICABLE' THEN 1 ELSE 0 END DESC, id) AS rn FROM compliance_assessments WHERE review_status = 'APPROVED') WHERE rn = 1""",
    ),
    "comp_evidence_summary": Query(lambda s, d: _summary(s, d), f"WITH {SUMMARY} SELECT * FROM s"),
    "comp_assess": Query(
        lambda s, d: C.derived_status(_a(s, d), _summary(s, d)),
        f"""WITH {SUMMARY} SELECT a.id, a.status AS stated, CASE WHEN coalesce(quotes, 0) = 0 THEN 'GAP' WHEN review_status IS DISTINCT FROM 'APPROVED' THEN 'PARTIAL' WHEN newest_age > 365 THEN 'PARTIAL' ELSE 'SATISFIED' END AS derived
FROM compliance_assessments a LEFT JOIN s ON a.id = s.assessment_id""",
    ),
    "comp_top_quotes": Query(
        lambda s, d: C.top_quotes(_e(s, d), 3),
        f"WITH {EVIDENCE} SELECT assessment_id, id, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY confidence DESC NULLS LAST, id) AS rank FROM e WHERE assessment_id IS NOT NULL) WHERE rank <= 3",
    ),
    "rag_evidence_caps": Query(
        lambda s, d: C.top_quotes(_e(s, d), 3, 30),
        f"""WITH {EVIDENCE} SELECT assessment_id, id, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY confidence DESC NULLS LAST, id) AS rank FROM e WHERE assessment_id IS NOT NULL)
WHERE rank <= 3 ORDER BY assessment_id, rank LIMIT 30""",
    ),
    "comp_evidence_for_artifact": Query(
        lambda s, d: _e(s, d).join(_e(s, d).where("artifact_id IS NOT NULL").groupBy("artifact_id").count().orderBy(F.desc("count"), "artifact_id").limit(1), "artifact_id", "left_semi").select("id", "assessment_id", "clause_ref"),
        f"WITH {EVIDENCE} SELECT id, assessment_id, clause_ref FROM e WHERE artifact_id = (SELECT artifact_id FROM e WHERE artifact_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, artifact_id LIMIT 1)",
    ),
    "comp_without_evidence": Query(
        lambda s, d: _a(s, d).join(_e(s, d).select(F.col("assessment_id").alias("id")), "id", "left_anti").select("id", "status"),
        f"WITH {EVIDENCE} SELECT id, status FROM compliance_assessments a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.assessment_id = a.id)",
    ),
    "comp_evidence_without_artifact": Query(
        lambda s, d: _e(s, d).where("artifact_id IS NOT NULL").join(table(s, d, "artifacts").select(F.col("id").alias("artifact_id")), "artifact_id", "left_anti").select("id", "artifact_id"),
        f"WITH {EVIDENCE} SELECT id, artifact_id FROM e WHERE artifact_id IS NOT NULL AND artifact_id NOT IN (SELECT id FROM artifacts WHERE id IS NOT NULL)",
    ),
    "comp_quote_in_text": Query(
        lambda s, d: _e(s, d).where("quote IS NOT NULL").join(table(s, d, "work_items").where("text IS NOT NULL").select(F.regexp_extract("artifact_dir", "[^/]*$", 0).alias("artifact_id"), "text").distinct(), "artifact_id")
        .select("id", F.contains("text", "quote").alias("verbatim")).distinct(),
        f"""WITH {EVIDENCE}, w AS (SELECT DISTINCT regexp_extract(artifact_dir, '[^/]*$') AS artifact_id, text FROM work_items WHERE text IS NOT NULL)
SELECT DISTINCT id, contains(text, quote) AS verbatim FROM e JOIN w ON e.artifact_id = w.artifact_id WHERE quote IS NOT NULL""",
    ),
    "comp_agent_latest": Query(
        lambda s, d: _a(s, d).where(F.col("assessor").startswith("agent:")).groupBy("requirement_object_id").agg(F.max_by("review_status", "id").alias("review_status"), F.max("id").alias("id")),
        """SELECT requirement_object_id, review_status, id FROM (SELECT *, row_number() OVER (PARTITION BY requirement_object_id ORDER BY id DESC) AS rn FROM compliance_assessments WHERE starts_with(assessor, 'agent:')) WHERE rn = 1""",
    ),
    "fn_needs_vision": Query(
        lambda s, d: _e(s, d).where("quote IS NOT NULL").select("id", measures.page_needs_vision(F.col("quote"), F.col("page_number").isNotNull()).alias("needs")).distinct(),
        f"WITH {EVIDENCE} SELECT DISTINCT id, regexp_matches(quote, '\\\\frac|\\\\sum|\\\\sqrt|\\\\int|\\$\\$|\\\\\\[|\\\\\\(|\\^\\{{|_\\{{|≤|≥|≈|∑|√|∫|×') OR (page_number IS NOT NULL AND length(trim(quote)) < 200) AS needs FROM e WHERE quote IS NOT NULL",
    ),
}
