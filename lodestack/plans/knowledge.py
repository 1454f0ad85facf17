"""Queries over a consolidated store. Parts are its objects, line items its edges and mentions, compliance evidence its evidence and requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import names
from lodestack.operators import governance as V
from lodestack.operators import knowledge as K
from lodestack.operators.components import components
from lodestack.plans import substrate as S
from lodestack.plans.registry import Query
from lodestack.runtime import table

KEY = "part/7"
NOW = "2002-01-01"


def _objects(spark, d):  # noqa: ANN001, ANN202
    """id, kind, name, confidence, status."""
    k = F.col("p_partkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("PENDING_REVIEW", "APPROVED", "APPROVED", "REJECTED")]), (k % 4 + 1).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("part/"), k.cast("string")).alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.round(F.col("p_size") / 50, 3).alias("confidence"), status.alias("status"))


def _edges(spark, d):  # noqa: ANN001, ANN202
    """id, source, predicate, target, confidence, review_status, evidence (a JSON list, empty where no line was taxed above 2 %)."""
    li = table(spark, d, "lineitem").where("l_partkey <> l_suppkey")
    predicate = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "N", "depends_on").otherwise("related_to")
    e = li.groupBy("l_partkey", "l_suppkey", predicate.alias("predicate")).agg(F.max(F.round(F.col("l_discount") * 10, 2)).alias("confidence"), F.count_if(F.col("l_tax") > 0.02).alias("taxed"))
    source, target = (F.concat(F.lit("part/"), F.col(c).cast("string")) for c in ("l_partkey", "l_suppkey"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("APPROVED", "PENDING_REVIEW", "REJECTED")]), ((F.col("l_partkey") + F.col("l_suppkey")) % 3 + 1).cast("int"))
    return e.select(F.concat_ws(">", source, "predicate", target).alias("id"), source.alias("source"), "predicate", target.alias("target"), "confidence", status.alias("review_status"), F.when(F.col("taxed") > 0, '[{"quote": "x"}]').otherwise("[]").alias("evidence"))


def _evidence(spark, d):  # noqa: ANN001, ANN202
    """id, object_id, artifact_id, quote, confidence."""
    e = table(spark, d, "compliance_assessment_evidence").distinct()
    return e.select("id", F.concat(F.lit("part/"), F.col("assessment_id").cast("string")).alias("object_id"), "artifact_id", "quote", "confidence")


def _lifecycle(spark, d):  # noqa: ANN001, ANN202
    """object_id, review_state, freshness_score, freshness_state, reviewed_at, owner: by the last line item of a part."""
    last = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_shipdate").alias("reviewed_at"))
    age = F.datediff(F.lit(NOW).cast("date"), F.col("reviewed_at").cast("date"))
    p = table(spark, d, "part").join(last, F.col("p_partkey") == F.col("k"), "left").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("owner")), "p_partkey", "left")
    o = _objects(spark, d).select(F.col("id").alias("object_id"), F.col("status").alias("review_state"))
    own = p.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("object_id"), F.round(F.greatest(F.lit(0.0), 1 - age / 1000), 3).alias("freshness_score"), F.when(age >= 365, "STALE").when(age >= 180, "AGING").otherwise("FRESH").alias("freshness_state"), F.col("reviewed_at").cast("timestamp").alias("reviewed_at"), "owner")
    return o.join(own, "object_id")


STORE = f"""o AS (SELECT 'part/' || p_partkey AS id, p_type AS kind, p_name AS name, round(p_size / 50, 3) AS confidence, ['PENDING_REVIEW', 'APPROVED', 'APPROVED', 'REJECTED'][p_partkey % 4 + 1] AS status FROM part),
e0 AS (SELECT l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'N' THEN 'depends_on' ELSE 'related_to' END AS predicate, max(round(l_discount * 10, 2)) AS confidence, count(*) FILTER (l_tax > 0.02) AS taxed FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2, 3),
e AS (SELECT 'part/' || l_partkey || '>' || predicate || '>part/' || l_suppkey AS id, 'part/' || l_partkey AS source, predicate, 'part/' || l_suppkey AS target, confidence, ['APPROVED', 'PENDING_REVIEW', 'REJECTED'][(l_partkey + l_suppkey) % 3 + 1] AS review_status, taxed FROM e0),
ev AS (SELECT DISTINCT id, 'part/' || assessment_id AS object_id, artifact_id, quote, confidence FROM (SELECT DISTINCT * FROM compliance_assessment_evidence)),
age AS (SELECT p_partkey, date_diff('day', max(l_shipdate)::DATE, DATE '{NOW}') AS age FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1),
life AS (SELECT 'part/' || p_partkey AS object_id, status AS review_state, round(greatest(0, 1 - age / 1000), 3) AS freshness_score, CASE WHEN age >= 365 THEN 'STALE' WHEN age >= 180 THEN 'AGING' ELSE 'FRESH' END AS freshness_state, age,
  s_name AS owner FROM age JOIN o ON o.id = 'part/' || p_partkey LEFT JOIN supplier ON s_suppkey = p_partkey)"""

QUALITY = f"""{STORE}, ne AS (SELECT object_id, count(*) AS n FROM ev GROUP BY 1), ends AS (SELECT source AS id, review_status FROM e UNION ALL SELECT target, review_status FROM e),
nr AS (SELECT id, count(*) AS n, count(*) FILTER (review_status = 'REJECTED') AS bad FROM ends GROUP BY 1),
f AS (SELECT o.id AS object_id, least(1::DOUBLE, coalesce(ne.n, 0) / 5) AS a, CASE review_state WHEN 'APPROVED' THEN 1::DOUBLE WHEN 'REJECTED' THEN 0::DOUBLE ELSE 0.4::DOUBLE END AS b, freshness_score AS c,
  CASE WHEN nr.n > 0 THEN 1 - nr.bad / nr.n ELSE 1::DOUBLE END AS x, CASE WHEN owner IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS y, least(1::DOUBLE, o.confidence) AS z
  FROM o JOIN life ON life.object_id = o.id LEFT JOIN ne ON ne.object_id = o.id LEFT JOIN nr ON nr.id = o.id),
q AS (SELECT object_id, round(a, 3) AS evidence_score, round(b, 3) AS review_score, round(c, 3) AS freshness_score, round(x, 3) AS consistency_score, y AS owner_score, round(z, 3) AS confidence_score,
  round(round((0.2::DOUBLE * a + 0.2::DOUBLE * b + 0.15::DOUBLE * c + 0.15::DOUBLE * x + 0.1::DOUBLE * y + 0.2::DOUBLE * z) * 100, 6), 1) AS quality_score FROM f)"""


def _quality(spark, d):  # noqa: ANN001, ANN202
    return V.quality(V.quality_inputs(_objects(spark, d), _evidence(spark, d), _edges(spark, d), _lifecycle(spark, d)))


def _orphans(spark, d):  # noqa: ANN001, ANN202
    owned = _lifecycle(spark, d).where("owner IS NOT NULL").select("object_id")
    return V.orphans(_objects(spark, d), _evidence(spark, d), _edges(spark, d), owned)


ORPHANS = """orph AS (SELECT 'objects_without_evidence' AS report, id FROM o WHERE id NOT IN (SELECT object_id FROM ev WHERE object_id IS NOT NULL)
UNION ALL SELECT 'objects_without_relationships', id FROM o WHERE id NOT IN (SELECT source FROM e WHERE review_status <> 'REJECTED' UNION SELECT target FROM e WHERE review_status <> 'REJECTED')
UNION ALL SELECT 'objects_without_owner', object_id FROM life WHERE owner IS NULL UNION ALL SELECT 'relationships_without_evidence', id FROM e WHERE review_status <> 'REJECTED' AND taxed = 0
UNION ALL SELECT 'evidence_without_object', id::VARCHAR FROM ev WHERE object_id IS NULL OR object_id NOT IN (SELECT id FROM o))"""


def _alerts(spark, d):  # noqa: ANN001, ANN202
    conflicts = _evidence(spark, d).groupBy("object_id").agg(F.max("confidence").alias("hi"), F.min("confidence").alias("lo")).where("hi >= 0.8 AND lo <= 0.4 AND object_id IS NOT NULL")
    return V.alerts(_lifecycle(spark, d), _orphans(spark, d), conflicts, _quality(spark, d).where("quality_score < 30"), F.lit(NOW).cast("timestamp"))


ALERTS = f"""{QUALITY}, {ORPHANS}, last AS (SELECT 'part/' || l_partkey AS object_id, max(l_shipdate) AS t FROM lineitem GROUP BY 1),
al AS (SELECT 'STALE_KNOWLEDGE' AS alert_type, 'WARNING' AS severity, object_id FROM life WHERE freshness_state = 'STALE'
UNION ALL SELECT 'STALE_REVIEW', 'WARNING', life.object_id FROM life JOIN last USING (object_id) WHERE review_state = 'APPROVED' AND t <= TIMESTAMP '{NOW}' - INTERVAL 180 DAY
UNION ALL SELECT 'ORPHANED_OBJECT', 'INFO', id FROM orph WHERE report = 'objects_without_relationships' UNION ALL SELECT 'ORPHANED_OBJECT', 'CRITICAL', id FROM orph WHERE report = 'objects_without_evidence'
UNION ALL SELECT 'MISSING_OWNER', 'INFO', id FROM orph WHERE report = 'objects_without_owner'
UNION ALL SELECT 'CONFLICTING_EVIDENCE', 'WARNING', object_id FROM ev WHERE object_id IS NOT NULL GROUP BY 3 HAVING max(confidence) >= 0.8 AND min(confidence) <= 0.4
UNION ALL SELECT 'QUALITY_DEGRADATION', 'WARNING', object_id FROM q WHERE quality_score < 30)"""


def _members(spark, d):  # noqa: ANN001, ANN202
    """object_id, domain: a part's brand."""
    return table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("object_id"), F.col("p_brand").alias("domain"))


def _requirements(spark, d):  # noqa: ANN001, ANN202
    """Requirements as quotes say them: the standard is the assessment, the clause is the quote's. seq is the evidence's id."""
    e = table(spark, d, "compliance_assessment_evidence").distinct()
    return e.select(F.concat(F.lit("STD "), F.col("assessment_id").cast("string")).alias("standard_name"), "clause_ref", F.lit(None).cast("string").alias("title"), F.col("quote").alias("text"), "quote", "artifact_id", "confidence", F.col("id").alias("seq")).where("standard_name IS NOT NULL")


def _named(spark, d):  # noqa: ANN001, ANN202
    """Mentions of the objects these make: object_id, object_type, name, artifact_id, confidence, quote, seq."""
    r = _requirements(spark, d)
    name = K.requirement_name(F.col("standard_name"), F.col("clause_ref"), F.col("title"))
    rest = ["artifact_id", "confidence", "quote", "seq"]
    req = r.where(F.trim(F.coalesce("clause_ref", F.lit(""))) != "").select(F.lit("Requirement").alias("object_type"), name.alias("name"), *rest)
    both = req.unionByName(r.select(F.lit("Standard").alias("object_type"), F.col("standard_name").alias("name"), *rest))
    return both.withColumn("object_id", F.concat_ws("_", F.lower("object_type"), names.slugify(F.col("name"))))


def _surface(spark, d):  # noqa: ANN001, ANN202
    return _named(spark, d).select(names.normalize_name(F.col("name")).alias("norm"), "object_id").distinct()


def _standards(spark, d):  # noqa: ANN001, ANN202
    return _named(spark, d).where("object_type = 'Standard'").select("name", "object_id").distinct()


REQS = f"""r AS (SELECT DISTINCT 'STD ' || assessment_id AS standard, trim(coalesce(clause_ref, '')) AS clause, quote, artifact_id, coalesce(confidence, 0) AS confidence, id AS seq FROM compliance_assessment_evidence WHERE assessment_id IS NOT NULL),
n AS (SELECT 'requirement_' || {S.slug_sql("standard || ' ' || clause")} AS req, 'standard_' || {S.slug_sql('standard')} AS std, * FROM r)"""


def _appearing(spark, d):  # noqa: ANN001, ANN202
    mandated = K.mandated_by(_requirements(spark, d), _surface(spark, d))
    return K.unless_linked(K.appears_in(_named(spark, d).where("artifact_id IS NOT NULL")), mandated).select("source", "predicate", "target", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def _consolidated(spark, d):  # noqa: ANN001, ANN202
    r, s, n = _requirements(spark, d), _surface(spark, d), _named(spark, d)
    edges = K.consolidated(K.mandated_by(r, s), [], K.references(r, s, _standards(spark, d)), K.appears_in(n.where("artifact_id IS NOT NULL")))
    before = _edges(spark, d).select("source", "predicate", "target", "review_status")
    return K.with_kept_reviews(edges, before)


def _usage(spark, d):  # noqa: ANN001, ANN202
    """Events as calls: the model by the event's type, every fourth call unpriced."""
    e = table(spark, d, "events")
    return e.select("event_type", "user_id", F.col("user_id").alias("total_tokens"), F.when(F.col("event_id") % 4 != 0, F.round(F.col("value") * 100).cast("long")).alias("cost_hundredths"))


def _of(frame, condition, sql, columns="*"):  # noqa: ANN001, ANN202
    return Query(lambda s, d: frame(s, d).where(condition).selectExpr(*columns.split(", ")), f"WITH {STORE} SELECT {columns} FROM {sql}")


EDGE = "id, source, predicate, target, confidence, review_status"
QUERIES = {
    "kg_object": _of(_objects, f"id = '{KEY}'", f"o WHERE id = '{KEY}'"),
    "kg_all_objects": _of(_objects, "true", "o"),
    "kg_objects_by_status": _of(_objects, "status = 'APPROVED'", "o WHERE status = 'APPROVED'"),
    "kg_object_types": Query(lambda s, d: _objects(s, d).groupBy("kind").agg(F.count("*").alias("n")), f"WITH {STORE} SELECT kind, count(*) AS n FROM o GROUP BY 1"),
    "kg_all_relationships": _of(_edges, "true", "e", EDGE),
    "kg_relationships_by_status": _of(_edges, "review_status = 'PENDING_REVIEW'", "e WHERE review_status = 'PENDING_REVIEW'", EDGE),
    "kg_relationships_between": Query(lambda s, d: K.between(_edges(s, d), 0.3, 0.6, review_status="APPROVED").selectExpr(*EDGE.split(", ")), f"WITH {STORE} SELECT {EDGE} FROM e WHERE confidence BETWEEN 0.3 AND 0.6 AND review_status = 'APPROVED'"),
    "kg_relationships_of": Query(
        lambda s, d: K.touching(_edges(s, d), _objects(s, d), KEY).select("id", "source_name", "target_name", "confidence"),
        f"WITH {STORE} SELECT e.id, coalesce(a.name, source) AS source_name, coalesce(b.name, target) AS target_name, e.confidence FROM e LEFT JOIN o a ON a.id = source LEFT JOIN o b ON b.id = target WHERE source = '{KEY}' OR target = '{KEY}'",
    ),
    "kg_mentions_of": Query(
        lambda s, d: table(s, d, "lineitem").where("l_partkey = 7").select(F.concat(F.lit("doc_"), F.col("l_orderkey").cast("string")).alias("artifact_id"), F.round(F.col("l_discount") * 10, 2).alias("confidence")),
        "SELECT 'doc_' || l_orderkey AS artifact_id, round(l_discount * 10, 2) AS confidence FROM lineitem WHERE l_partkey = 7",
    ),
    "kg_evidence_of": _of(_evidence, f"object_id = '{KEY}'", f"ev WHERE object_id = '{KEY}'"),
    "kg_evidence_counts": Query(lambda s, d: _evidence(s, d).groupBy("object_id").agg(F.count("*").alias("n"), F.count_distinct("artifact_id").alias("documents")), f"WITH {STORE} SELECT object_id, count(*) AS n, count(DISTINCT artifact_id) AS documents FROM ev GROUP BY 1"),
    "kg_approved_relationships": Query(
        lambda s, d: K.approved_edges(_edges(s, d), _objects(s, d)).selectExpr(*EDGE.split(", ")),
        f"WITH {STORE} SELECT {EDGE} FROM e WHERE review_status = 'APPROVED' AND source IN (SELECT id FROM o WHERE status = 'APPROVED') AND target IN (SELECT id FROM o WHERE status = 'APPROVED')",
    ),
    "kg_evidence_for_approved": Query(
        lambda s, d: _evidence(s, d).join(_objects(s, d).where("status = 'APPROVED'").select(F.col("id").alias("object_id"), "kind"), "object_id").select("id", "object_id", "kind", "quote"),
        f"WITH {STORE} SELECT ev.id, object_id, kind, quote FROM ev JOIN o ON o.id = object_id WHERE status = 'APPROVED'",
    ),
    "kg_islands": Query(
        lambda s, d: (lambda e, o: V.islands(components(e.select(F.col("source").alias("a"), F.col("target").alias("b"))), o))(K.approved_edges(_edges(s, d), _objects(s, d)), _objects(s, d).where("status = 'APPROVED'")).groupBy("size").agg(F.count("*").alias("n"))
    ),
    "kg_low_confidence": Query(lambda s, d: _objects(s, d).where("status = 'APPROVED' AND confidence < 0.5").select("id", "confidence"), f"WITH {STORE} SELECT id, confidence FROM o WHERE status = 'APPROVED' AND confidence < 0.5"),
    "kg_mandated_by": Query(
        lambda s, d: K.gathered(K.mandated_by(_requirements(s, d), _surface(s, d))),
        f"""WITH {REQS}, x AS (SELECT req, std, confidence, seq, CASE WHEN trim(coalesce(quote, '')) <> '' THEN trim(quote) END AS q FROM n WHERE clause <> ''),
y AS (SELECT *, row_number() OVER (PARTITION BY req, std ORDER BY q IS NULL, seq, q) AS rn FROM (SELECT req, std, seq, q FROM x GROUP BY ALL))
SELECT x.req AS source, 'mandated_by' AS predicate, x.std AS target, max(x.confidence) AS confidence, count(*) AS said, coalesce((SELECT string_agg(y.q, ' | ' ORDER BY y.rn) FROM y WHERE y.req = x.req AND y.std = x.std AND y.rn <= 3), '') AS quotes FROM x GROUP BY 1, 2, 3""",
    ),
    "kg_appears_in": Query(
        _appearing,
        f"""WITH {REQS}, m AS (SELECT std AS id, artifact_id FROM n WHERE artifact_id IS NOT NULL), x AS (SELECT req, artifact_id, max(confidence) AS confidence FROM n WHERE clause <> '' AND artifact_id IS NOT NULL GROUP BY 1, 2)
SELECT req AS source, 'appears_in' AS predicate, id AS target, max(confidence) AS confidence FROM x JOIN m USING (artifact_id) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.req = x.req AND n.std = m.id AND clause <> '') GROUP BY 1, 3""",
    ),
    "kg_cross_references": Query(lambda s, d: K.gathered(K.references(_requirements(s, d), _surface(s, d), _standards(s, d)))),
    "kg_consolidated": Query(_consolidated),
    "gov_quality": Query(_quality, f"WITH {QUALITY} SELECT * FROM q"),
    "gov_average_quality": Query(lambda s, d: _quality(s, d).agg(F.round(F.avg("quality_score"), 4).alias("average"), F.count("*").alias("n")), f"WITH {QUALITY} SELECT round(avg(quality_score), 4) AS average, count(*) AS n FROM q"),
    "gov_quality_ranked": Query(lambda s, d: _quality(s, d).orderBy("quality_score", "object_id").limit(25).select("object_id", "quality_score"), f"WITH {QUALITY} SELECT object_id, quality_score FROM q ORDER BY 2, 1 LIMIT 25"),
    "gov_domain_health": Query(
        lambda s, d: V.domain_health(_members(s, d), _quality(s, d), _lifecycle(s, d)),
        f"""WITH {QUALITY} SELECT p_brand AS domain, count(*) AS object_count, round(sum(round(quality_score * 1000)::BIGINT)::BIGINT / count(*) / 1000, 1) AS avg_quality, round(sum(round(life.freshness_score * 1000)::BIGINT)::BIGINT / count(*) / 1000, 3) AS avg_freshness, count(*) FILTER (review_state = 'PENDING_REVIEW') AS review_backlog
FROM part JOIN q ON q.object_id = 'part/' || p_partkey JOIN life ON life.object_id = q.object_id GROUP BY 1""",
    ),
    "gov_lifecycle_by_freshness": Query(lambda s, d: _lifecycle(s, d).groupBy("freshness_state").agg(F.count("*").alias("n"), F.min("freshness_score").alias("least")), f"WITH {STORE} SELECT freshness_state, count(*) AS n, min(freshness_score) AS least FROM life GROUP BY 1"),
    "gov_lifecycle_by_review": Query(lambda s, d: _lifecycle(s, d).where("review_state = 'PENDING_REVIEW'").select("object_id", "freshness_score", "owner"), f"WITH {STORE} SELECT object_id, freshness_score, owner FROM life WHERE review_state = 'PENDING_REVIEW'"),
    "gov_all_orphans": Query(_orphans, f"WITH {STORE}, {ORPHANS} SELECT * FROM orph"),
    "gov_alerts": Query(_alerts, f"WITH {ALERTS} SELECT * FROM al"),
    "gov_alert_counts": Query(lambda s, d: _alerts(s, d).groupBy("alert_type").agg(F.count("*").alias("n")), f"WITH {ALERTS} SELECT alert_type, count(*) AS n FROM al GROUP BY 1"),
    "gov_store_counts": Query(
        lambda s, d: _objects(s, d).agg(F.count("*").alias("objects"), F.count_if(F.col("status") == "APPROVED").alias("approved"), F.count_if(F.col("status") == "PENDING_REVIEW").alias("pending")).crossJoin(_edges(s, d).agg(F.count("*").alias("relationships"))).crossJoin(_evidence(s, d).agg(F.count("*").alias("evidence"))),
        f"WITH {STORE} SELECT (SELECT count(*) FROM o) AS objects, (SELECT count(*) FROM o WHERE status = 'APPROVED') AS approved, (SELECT count(*) FROM o WHERE status = 'PENDING_REVIEW') AS pending, (SELECT count(*) FROM e) AS relationships, (SELECT count(*) FROM ev) AS evidence",
    ),
    "cost_by_model": Query(
        lambda s, d: V.spending(_usage(s, d), "event_type"),
        "SELECT event_type AS key, count(*) AS calls, coalesce(sum(user_id), 0)::BIGINT AS total_tokens, round(sum(CASE WHEN event_id % 4 <> 0 THEN round(value * 100)::BIGINT END)::BIGINT / 100, 2) AS cost, count(*) FILTER (event_id % 4 = 0 OR value IS NULL) AS unpriced_calls FROM events GROUP BY 1",
    ),
}
