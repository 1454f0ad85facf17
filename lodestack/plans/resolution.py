"""Queries of name functions, similarity, clusters and relationship resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import measures, names
from lodestack.operators import resolution as R
from lodestack.plans import substrate as S
from lodestack.plans.registry import Query
from lodestack.runtime import cut, table


def _names(spark, d):  # noqa: ANN001, ANN202
    return S.part_names(spark, d)


def _reps(spark, d):  # noqa: ANN001, ANN202
    return _names(spark, d).select("kind", "name").distinct().select(F.concat_ws("|", "kind", "name").alias("id"), "kind", "name")


PAIRS = f"""{S.NAMES}, reps AS (SELECT DISTINCT kind || '|' || name AS id, kind, name, {S.norm_sql('name')} AS norm FROM names),
p AS (SELECT *, {S.tokens_sql('norm')} AS tokens, {S.grams_sql('norm')} AS grams FROM reps),
pairs AS (SELECT l.id AS l_id, r.id AS r_id, round({S.SCORE}, 6) AS score FROM p l JOIN p r ON l.kind = r.kind AND l.id < r.id)"""

BUCKETS = f"""{S.MENTIONS}, kept AS (SELECT *, {S.norm_sql('name')} AS norm FROM m WHERE confidence >= 0.3),
forms AS (SELECT kind, norm, name, count(*) AS n FROM kept WHERE norm <> '' GROUP BY ALL),
b AS (SELECT kind, norm, name, mentions, kind || '|' || norm AS id FROM (SELECT *, sum(n) OVER (PARTITION BY kind, norm)::BIGINT AS mentions, row_number() OVER (PARTITION BY kind, norm
  ORDER BY n DESC, len(regexp_split_to_array(trim(name), '\\s+')), length(name), lower(name), name) AS rn FROM forms) WHERE rn = 1)"""

CLUSTERS = f"""{BUCKETS}, p AS (SELECT *, {S.tokens_sql('normed')} AS tokens, {S.grams_sql('normed')} AS grams FROM (SELECT id, kind, norm, {S.norm_sql('name')} AS normed FROM b)),
q AS (SELECT id, kind, normed AS norm, tokens, grams FROM p),
e AS (SELECT * FROM (SELECT l.id AS l_id, r.id AS r_id, round({S.SCORE}, 6) AS score FROM q l JOIN q r ON l.kind = r.kind AND l.id < r.id AND list_has_any(l.tokens, r.tokens)) WHERE score >= 0.88),
s AS (SELECT l_id AS a, r_id AS b FROM e UNION SELECT r_id, l_id FROM e),
w AS (SELECT id, id AS reached FROM b UNION SELECT w.id, s.b FROM w JOIN s ON w.reached = s.a),
c AS (SELECT id, min(reached) AS cluster FROM w GROUP BY id),
k AS (SELECT cluster, min(score) AS weakest FROM e JOIN c ON e.l_id = c.id GROUP BY cluster),
placed AS (SELECT b.id, b.kind, b.norm, b.name, b.mentions, c.cluster, round(coalesce(k.weakest, 1), 3) AS cohesion FROM b JOIN c ON b.id = c.id LEFT JOIN k ON c.cluster = k.cluster),
spelled AS (SELECT x.*, placed.cluster, placed.cohesion FROM kept x JOIN placed ON x.kind = placed.kind AND x.norm = placed.norm),
best AS (SELECT cluster, name AS canonical_name FROM (SELECT cluster, name, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, len(regexp_split_to_array(trim(name), '\\s+')), length(name), lower(name), name) AS rn FROM spelled GROUP BY cluster, name) WHERE rn = 1),
report AS (SELECT cluster, kind, cohesion, count(DISTINCT artifact_id) AS documents, count(*) AS mentions, round(sum(round(confidence * 10000)::BIGINT)::BIGINT / count(*) / 10000, 6) AS mean_confidence FROM spelled GROUP BY cluster, kind, cohesion)"""


def _clusters(spark, d):  # noqa: ANN001, ANN202
    return R.clusters(S.mentions(spark, d))


def _report(spark, d):  # noqa: ANN001, ANN202
    m = S.mentions(spark, d)
    return R.cluster_report(m, cut(R.clusters(m)))


def _similar(spark, d):  # noqa: ANN001, ANN202
    p = R.prepared(_names(spark, d).select("name").distinct())
    return p.select("name", "norm", F.array_join(F.array_sort("tokens"), " ").alias("tokens"), F.size("grams").alias("grams"))


def _resolved(spark, d):  # noqa: ANN001, ANN202
    n = _names(spark, d)
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_discount")
    raw = li.join(n.select(F.col("p_partkey").alias("l_partkey"), F.col("name").alias("subject")), "l_partkey").join(n.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("object")), "l_suppkey")
    raw = raw.select("subject", F.col("l_returnflag").alias("predicate"), "object", F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.concat_ws("/", *[F.col(c).cast("long").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]).alias("quote"))
    surface = n.select(names.normalize_name(F.col("name")).alias("norm"), F.concat(F.lit("part_"), names.slugify(F.col("p_name"))).alias("object_id"))
    return R.resolve_relationships(raw.withColumn("seq", F.col("quote")), surface)


RESOLVED = f"""WITH {S.NAMES}, raw AS (SELECT a.name AS subject, l_returnflag AS predicate, b.p_name AS object, round(l_discount * 10, 2) AS confidence,
  l_orderkey::BIGINT || '/' || l_linenumber || '/' || l_partkey || '/' || l_quantity::BIGINT AS quote FROM lineitem JOIN names a ON l_partkey = a.p_partkey JOIN names b ON l_suppkey = b.p_partkey),
surface AS (SELECT norm, min(oid) AS object_id FROM (SELECT {S.norm_sql('name')} AS norm, 'part_' || {S.slug_sql('p_name')} AS oid FROM names) GROUP BY norm),
ends AS (SELECT DISTINCT norm FROM (SELECT {S.norm_sql('subject')} AS norm FROM raw UNION ALL SELECT {S.norm_sql('object')} FROM raw) WHERE norm <> ''),
op AS (SELECT norm, {S.tokens_sql('norm')} AS tokens, {S.grams_sql('norm')} AS grams FROM ends WHERE norm NOT IN (SELECT norm FROM surface)),
sp AS (SELECT norm, object_id, {S.tokens_sql('norm')} AS tokens, {S.grams_sql('norm')} AS grams FROM surface),
near AS (SELECT l.norm, r.object_id, round({S.SCORE}, 6) AS score FROM op l JOIN sp r ON list_has_any(l.tokens, r.tokens)),
best AS (SELECT norm, object_id FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, object_id) AS rn FROM near WHERE score >= 0.88) WHERE rn = 1),
known AS (SELECT norm, object_id FROM surface UNION ALL SELECT norm, object_id FROM best),
t AS (SELECT s.object_id AS source, predicate, o.object_id AS target, confidence, quote, row_number() OVER (PARTITION BY s.object_id, predicate, o.object_id ORDER BY quote) AS r
  FROM raw JOIN known s ON s.norm = {S.norm_sql('subject')} JOIN known o ON o.norm = {S.norm_sql('object')} WHERE s.object_id <> o.object_id)
SELECT source, predicate, target, max(confidence) AS confidence, count(*) AS said, string_agg(quote, ' | ' ORDER BY quote) FILTER (r <= 3) AS quotes FROM t GROUP BY 1, 2, 3"""


QUERIES = {
    "fn_slug_object_id": Query(
        lambda s, d: _names(s, d).select("p_partkey", names.slugify(F.col("name")).alias("slug"), names.object_id(F.col("kind"), F.col("name")).alias("object_id")),
        f"WITH {S.NAMES} SELECT p_partkey, {S.slug_sql('name')} AS slug, {S.slug_sql('kind')} || '_' || {S.slug_sql('name')} AS object_id FROM names",
    ),
    "fn_uri_round_trip": Query(
        lambda s, d: (lambda i: _names(s, d).select("p_partkey", names.id_to_uri(i).alias("uri"), names.uri_to_id(names.id_to_uri(i)).alias("id"), names.local_name(names.id_to_uri(i)).alias("local")))(names.object_id(F.col("kind"), F.col("name"))),
        f"""WITH {S.NAMES}, i AS (SELECT p_partkey, {S.slug_sql('kind')} AS k, {S.slug_sql('name')} AS n FROM names) SELECT p_partkey, 'kg/' || k || '/' || n AS uri, k || '_' || n AS id, n AS local FROM i""",
    ),
    "fn_normalize_name": Query(
        lambda s, d: table(s, d, "documents").select("doc_id", names.normalize_name(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))).alias("norm")),
        f"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g'), '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS norm FROM documents""",
    ),
    "fn_display_name": Query(
        lambda s, d: table(s, d, "compliance_assessment_evidence").select("id", names.display_name((F.col("artifact_id"), F.col("clause_ref")), (F.col("clause_ref"),), (F.col("artifact_id"),), otherwise="requirement").alias("name")).distinct(),
        """SELECT DISTINCT id, CASE WHEN trim(coalesce(artifact_id, '')) <> '' AND trim(coalesce(clause_ref, '')) <> '' THEN trim(artifact_id) || ' ' || trim(clause_ref)
WHEN trim(coalesce(clause_ref, '')) <> '' THEN trim(clause_ref) WHEN trim(coalesce(artifact_id, '')) <> '' THEN trim(artifact_id) ELSE 'requirement' END AS name FROM compliance_assessment_evidence""",
    ),
    "fn_derived_title": Query(
        lambda s, d: table(s, d, "compliance_assessments").where("rationale IS NOT NULL").select("id", names.derived_title(F.col("rationale")).alias("title")),
        r"""SELECT id, array_to_string(list_slice(string_split(regexp_replace(trim(regexp_extract(trim(rationale), '^[^.;:\n]*')), '\s+', ' ', 'g'), ' '), 1, 8), ' ') AS title FROM compliance_assessments WHERE rationale IS NOT NULL""",
    ),
    "fn_key_tokens": Query(
        _similar,
        f"""WITH {S.NAMES}, n AS (SELECT DISTINCT name, {S.norm_sql('name')} AS norm FROM names) SELECT name, norm, array_to_string(list_sort({S.tokens_sql('norm')}), ' ') AS tokens, len({S.grams_sql('norm')}) AS grams FROM n""",
    ),
    "resolve_duplicate_candidates": Query(
        lambda s, d: R.blocked_pairs(_reps(s, d), names.REVIEW).where(F.col("score") < names.MERGE), f"WITH {PAIRS} SELECT * FROM pairs WHERE score >= 0.72 AND score < 0.88"
    ),
    "resolve_similar_pairs": Query(lambda s, d: R.blocked_pairs(_reps(s, d), names.MERGE), f"WITH {PAIRS} SELECT * FROM pairs WHERE score >= 0.88"),
    "resolve_buckets": Query(lambda s, d: R.buckets(S.mentions(s, d)), f"WITH {BUCKETS} SELECT kind, norm, name, mentions, id FROM b"),
    "resolve_clusters": Query(_clusters, f"WITH RECURSIVE {CLUSTERS} SELECT id, kind, norm, name, mentions, cluster, cohesion FROM placed"),
    "resolve_cluster_report": Query(_report, f"WITH RECURSIVE {CLUSTERS} SELECT r.*, canonical_name FROM report r JOIN best ON r.cluster = best.cluster"),
    "resolve_object_ids": Query(
        lambda s, d: R.with_ids(_report(s, d)).select("cluster", "object_id"),
        f"""WITH RECURSIVE {CLUSTERS}, i AS (SELECT r.*, canonical_name, {S.slug_sql('kind')} || '_' || {S.slug_sql('canonical_name')} AS base FROM report r JOIN best ON r.cluster = best.cluster),
o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY documents DESC, mentions DESC, lower(canonical_name), cluster) AS n FROM i) SELECT cluster, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS object_id FROM o""",
    ),
    "resolve_object_score": Query(
        lambda s, d: _report(s, d).select("cluster", measures.confidence(F.col("mean_confidence"), F.col("documents"), F.col("mentions"), F.lit(1.0)).alias("confidence")),
        f"""WITH RECURSIVE {CLUSTERS} SELECT cluster, round(greatest(0, least(1, 0.45::DOUBLE * mean_confidence + 0.25::DOUBLE * least(1, documents / 8) + 0.15::DOUBLE * least(1, mentions / 12) + 0.15::DOUBLE)), 3) AS confidence FROM report""",
    ),
    "resolve_cross_type": Query(
        lambda s, d: R.cross_kind(R.buckets(S.mentions(s, d))), f"WITH {BUCKETS} SELECT l.norm, l.kind AS l_kind, r.kind AS r_kind FROM b l JOIN b r ON l.norm = r.norm AND l.kind < r.kind"
    ),
    "resolve_relationships": Query(_resolved, RESOLVED),
    "resolve_linked_pairs": Query(
        lambda s, d: R.linked_pairs(_resolved(s, d)),
        f"SELECT least(source, target) AS lo, greatest(source, target) AS hi, count(DISTINCT predicate) AS predicates FROM ({RESOLVED}) GROUP BY 1, 2 HAVING count(DISTINCT predicate) > 1",
    ),
}
