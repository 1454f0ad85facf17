"""Queries over classified documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import semantic as M
from lodestack.operators.scan import latest
from lodestack.plans import substrate as S
from lodestack.plans.registry import Query
from lodestack.runtime import table

ROWS = "c AS (SELECT DISTINCT * FROM document_classifications)"
DOMAINS = f"""{ROWS}, x AS (SELECT artifact_id, id, unnest(CAST(CASE WHEN json_valid(domains) AND starts_with(trim(domains), '[') THEN domains::JSON END AS JSON[])) AS j,
  generate_subscripts(CAST(CASE WHEN json_valid(domains) AND starts_with(trim(domains), '[') THEN domains::JSON END AS JSON[]), 1) - 1 AS position FROM c),
y AS (SELECT artifact_id, id, position, trim(CASE WHEN json_type(j) = 'OBJECT' THEN j->>'$.domain' ELSE j->>'$' END) AS domain,
  CASE WHEN json_type(j) = 'OBJECT' THEN greatest(0::DOUBLE, least(1::DOUBLE, coalesce(TRY_CAST(j->>'$.confidence' AS DOUBLE), 0.5))) ELSE 0.5 END AS confidence FROM x),
d AS (SELECT artifact_id, id, position, domain, confidence FROM y WHERE coalesce(domain, '') <> '')"""


def _rows(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "document_classifications").distinct()


def _exploded(spark, d):  # noqa: ANN001, ANN202
    return _rows(spark, d).select("artifact_id", "id", F.posexplode(M.parsed_domains(F.col("domains"))).alias("position", "d")).select("artifact_id", "id", "position", "d.*")


def _canonical(spark, d):  # noqa: ANN001, ANN202
    return M.canonical_map(_exploded(spark, d), table(spark, d, "domain_taxonomy"))


MAP = f"""{DOMAINS}, tax AS (SELECT DISTINCT domain, aliases FROM domain_taxonomy), known AS (SELECT {S.norm_sql('alias')} AS norm, max(domain) AS exact FROM (SELECT domain, unnest(list_concat([domain], coalesce(aliases, []))) AS alias FROM tax) GROUP BY 1),
l0 AS (SELECT DISTINCT domain AS name, {S.norm_sql('domain')} AS norm FROM d), lp AS (SELECT *, {S.tokens_sql('norm')} AS tokens, {S.grams_sql('norm')} AS grams FROM l0),
rp AS (SELECT *, {S.tokens_sql('norm')} AS tokens, {S.grams_sql('norm')} AS grams FROM (SELECT domain AS name, {S.norm_sql('domain')} AS norm FROM tax)),
near AS (SELECT l.name AS domain, r.name AS b, round({S.SCORE}, 6) AS score FROM lp l JOIN rp r ON list_has_any(l.tokens, r.tokens)),
best AS (SELECT domain, b AS similar FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, b DESC) AS rn FROM near WHERE score >= 0.9) WHERE rn = 1),
canon AS (SELECT l0.name AS domain, coalesce(exact, "similar") AS canonical FROM l0 LEFT JOIN known ON l0.norm = known.norm LEFT JOIN best ON best.domain = l0.name)"""

CANONICAL = f"""WITH {MAP}, kept AS (SELECT d.artifact_id, d.id * 1000 + d.position AS position, d.confidence, coalesce(canonical, d.domain) AS name, {S.norm_sql('coalesce(canonical, d.domain)')} AS norm FROM d LEFT JOIN canon ON d.domain = canon.domain WHERE confidence >= 0.6),
f AS (SELECT artifact_id, norm, arg_min(name, position) AS domain, max(confidence) AS confidence, min(position) AS position FROM kept GROUP BY 1, 2)
SELECT artifact_id, domain, confidence, row_number() OVER (PARTITION BY artifact_id ORDER BY position) - 1 AS rank FROM f WHERE artifact_id IS NOT NULL"""


def _canonical_domains(spark, d):  # noqa: ANN001, ANN202
    x = _exploded(spark, d).withColumn("position", F.col("id") * 1000 + F.col("position")).where("artifact_id IS NOT NULL")
    return M.canonical_domains(x, _canonical(spark, d))


def _concepts(spark, d):  # noqa: ANN001, ANN202
    concepts = _rows(spark, d).where("document_type IS NOT NULL").select("artifact_id", F.col("document_type").alias("concept"))
    return M.connecting(concepts, _exploded(spark, d).select("artifact_id", "domain"), 2)


def _count(column):  # noqa: ANN001, ANN202
    return Query(
        lambda s, d: _rows(s, d).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")), f"WITH {ROWS} SELECT {column} AS key, count(*) AS n FROM c GROUP BY 1"
    )


def _page(spark, d):  # noqa: ANN001, ANN202
    """Classifications between two confidences, best first, NULLs last."""
    return _rows(spark, d).where(F.col("type_confidence").between(0.5, 0.9) & (F.col("review_status") == "NEW")).select("id", "artifact_id", "type_confidence").orderBy(F.desc_nulls_last("type_confidence"), "id").limit(25)


QUERIES = {
    "sem_document_types": _count("document_type"),
    "sem_review_status": _count("review_status"),
    "sem_models": _count("model"),
    "sem_domains_parsed": Query(lambda s, d: _exploded(s, d), f"WITH {DOMAINS} SELECT artifact_id, id, position, domain, confidence FROM d"),
    "sem_top_domains": Query(
        lambda s, d: M.top_domains(_exploded(s, d)).orderBy(F.desc("documents"), "domain").limit(20),
        f"WITH {DOMAINS} SELECT domain, count(DISTINCT artifact_id) AS documents, round(avg(confidence), 3) AS average_confidence FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    ),
    "sem_name_frequency": Query(
        lambda s, d: M.name_frequency(_exploded(s, d), "domain"),
        f"WITH {DOMAINS} SELECT min(domain) AS name, count(*) AS mentions, count(DISTINCT artifact_id) AS documents, round(avg(confidence), 3) AS average_confidence FROM d GROUP BY lower(domain)",
    ),
    "sem_concepts_connecting": Query(
        _concepts,
        f"""WITH {DOMAINS}, t AS (SELECT document_type AS concept, domain FROM c JOIN d ON c.artifact_id = d.artifact_id WHERE document_type IS NOT NULL)
SELECT concept, count(DISTINCT domain) AS n, array_to_string(list_sort(list_distinct(list(domain))), '; ') AS domains FROM t GROUP BY 1 HAVING count(DISTINCT domain) >= 2""",
    ),
    "sem_canonical_map": Query(lambda s, d: _canonical(s, d), f"WITH {MAP} SELECT domain, canonical FROM canon"),
    "sem_canonical_domains": Query(_canonical_domains, CANONICAL),
    "sem_merge_results": Query(
        lambda s, d: M.merged(_rows(s, d)).select("artifact_id", "document_type", "type_confidence", "model", "parts"),
        f"""WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY type_confidence DESC NULLS LAST, id DESC NULLS LAST) AS rn, count(*) OVER (PARTITION BY artifact_id) AS parts FROM c)
SELECT artifact_id, document_type, type_confidence, model, parts FROM r WHERE rn = 1""",
    ),
    "sem_to_classify": Query(
        lambda s, d: table(s, d, "work_items").where("text IS NOT NULL").select(F.regexp_extract("artifact_dir", "[^/]*$", 0).alias("artifact_id"), F.sha2("text", 256).alias("hash")).distinct()
        .join(_rows(s, d).select("artifact_id", F.lower("source_hash").alias("hash")), ["artifact_id", "hash"], "left_anti"),
        f"""WITH {ROWS}, w AS (SELECT DISTINCT regexp_extract(artifact_dir, '[^/]*$') AS artifact_id, sha256(text) AS hash FROM work_items WHERE text IS NOT NULL)
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.artifact_id = w.artifact_id AND lower(c.source_hash) = w.hash)""",
    ),
    "sem_confidence_interval": Query(
        _page, f"WITH {ROWS} SELECT id, artifact_id, type_confidence FROM c WHERE type_confidence BETWEEN 0.5 AND 0.9 AND review_status = 'NEW' ORDER BY type_confidence DESC NULLS LAST, id LIMIT 25"
    ),
    "sem_search": Query(
        lambda s, d: _rows(s, d).where(F.col("short_summary").ilike("%roadmap%") | F.col("long_summary").ilike("%roadmap%") | F.col("document_type").ilike("%roadmap%")).select("id", "artifact_id"),
        f"WITH {ROWS} SELECT id, artifact_id FROM c WHERE short_summary ILIKE '%roadmap%' OR long_summary ILIKE '%roadmap%' OR document_type ILIKE '%roadmap%'",
    ),
    "sem_latest_review": Query(
        lambda s, d: latest(_rows(s, d).where("artifact_id IS NOT NULL").select("artifact_id", "id", "review_status"), ["artifact_id"], F.col("id")),
        f"WITH {ROWS} SELECT artifact_id, id, review_status FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY id DESC NULLS LAST) AS rn FROM c WHERE artifact_id IS NOT NULL) WHERE rn = 1",
    ),
}
