"""The pN_ queries of this subpackage, with the SQL that says the same where SQL can."""

from __future__ import annotations

from lodestack.llm import lookalikes, mixing, near_duplicates, packing, scans, splitting, subjects
from lodestack.plans.registry import Query
from lodestack.runtime import table


def _pieces(spark, d):  # noqa: ANN001, ANN202
    return splitting.split(table(spark, d, "work_items"), table(spark, d, "llm_config"))


def _packed(spark, d):  # noqa: ANN001, ANN202
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_jobs"))


def _mix(spark, d):  # noqa: ANN001, ANN202
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _groups(spark, d):  # noqa: ANN001, ANN202
    return near_duplicates.near_duplicate_groups(table(spark, d, "work_items"))


def _subjects(spark, d):  # noqa: ANN001, ANN202
    return subjects.subjects(table(spark, d, "work_items"), table(spark, d, "domain_taxonomy"), table(spark, d, "subject_examples"))


def _records(spark, d):  # noqa: ANN001, ANN202
    return scans.records(table(spark, d, "work_items"), table(spark, d, "compliance_assessment_evidence"))


P3_SQL = """
SELECT DISTINCT artifact_dir, config_id FROM work_items w JOIN llm_config c
ON coalesce(max_input_chars, 12000) > 0 AND length(text) > coalesce(max_input_chars, 12000)
"""
P6_SQL = "SELECT DISTINCT job_id, doc_id FROM pack_jobs j JOIN documents d ON strlen(d.text) > j.capacity_tokens AND capacity_tokens > 0"
P7_SQL = r"""
WITH s AS (SELECT lower(trim(source, e' \t\n\r')) AS src, sum(strlen(coalesce(text, ''))) AS tokens FROM documents GROUP BY 1)
SELECT DISTINCT mix_id, source FROM mix_targets t LEFT JOIN s ON s.src = lower(trim(t.source, e' \t\n\r'))
WHERE target_share * budget_ratio * (SELECT sum(tokens) FROM s) > max_repeats * coalesce(tokens, 0)
"""

QUERIES = {
    "p1_found": Query(lambda s, d: scans.found_noise(_records(s, d))),
    "p1_repaired": Query(lambda s, d: scans.repaired(_records(s, d))),
    "p2_found": Query(lambda s, d: subjects.assigned(_subjects(s, d))),
    "p2_mixtures": Query(_subjects),
    "p2_composition": Query(lambda s, d: subjects.composition(_subjects(s, d))),
    "p3_found": Query(lambda s, d: splitting.cut_items(_pieces(s, d)), P3_SQL),
    "p3_pieces": Query(_pieces),
    "p5_found": Query(lambda s, d: near_duplicates.group_pairs(_groups(s, d))),
    "p5_groups": Query(_groups),
    "p6_found": Query(lambda s, d: packing.split_documents(_packed(s, d)), P6_SQL),
    "p6_bins": Query(_packed),
    "p6_fill_report": Query(lambda s, d: packing.fill_report(_packed(s, d))),
    "p7_found": Query(lambda s, d: mixing.unmet(_mix(s, d)[1]), P7_SQL),
    "p7_mix": Query(lambda s, d: _mix(s, d)[0]),
    "p7_shares": Query(lambda s, d: _mix(s, d)[1]),
    "p8_found": Query(lambda s, d: lookalikes.lookalike_pairs(table(s, d, "documents"))),
    "p8_classes": Query(lambda s, d: lookalikes.skeleton_classes(table(s, d, "documents"))),
    "p8_normalised": Query(lambda s, d: lookalikes.normalised(table(s, d, "documents"))),
}
