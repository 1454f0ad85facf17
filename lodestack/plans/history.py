"""Queries over snapshots, logs and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import history as H
from lodestack.plans import substrate as S
from lodestack.plans.registry import Query
from lodestack.runtime import table


def _parts(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("label"))


def _snapshot(spark, d, later):  # noqa: ANN001, ANN202
    """Objects (a part name within a brand) and the orders they were in, before 2000 and since."""
    cut_off = F.lit("2000-01-01").cast("timestamp")
    li = table(spark, d, "lineitem").where((F.col("l_shipdate") >= cut_off) if later else (F.col("l_shipdate") < cut_off))
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_brand").alias("object_id"), F.col("p_type").alias("object_type"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("object_id").agg(F.min("object_type").alias("object_type"), F.count_distinct("l_orderkey").alias("document_count"))


DRIFT = """WITH s AS (SELECT p_name || '/' || p_brand AS object_id, p_type, l_orderkey, l_shipdate >= TIMESTAMP '2000-01-01' AS later FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT object_id, min(p_type) AS t, count(DISTINCT l_orderkey) AS n FROM s WHERE NOT later GROUP BY 1), c AS (SELECT object_id, min(p_type) AS t, count(DISTINCT l_orderkey) AS n FROM s WHERE later GROUP BY 1),
gone AS (SELECT * FROM p WHERE n >= 5 AND object_id NOT IN (SELECT object_id FROM c)), new AS (SELECT * FROM c WHERE object_id NOT IN (SELECT object_id FROM p))
SELECT 'removed' AS kind, object_id, '' AS related_id FROM gone UNION ALL SELECT 'terminology_change', gone.object_id, new.object_id FROM gone JOIN new ON gone.t = new.t
UNION ALL SELECT 'disappearing_evidence', p.object_id, '' FROM p JOIN c ON p.object_id = c.object_id WHERE p.n > 0 AND c.n < p.n AND c.n / p.n <= 0.5"""


def _changed(spark, d):  # noqa: ANN001, ANN202
    r, since = S.relationships(spark, d), F.lit("2000-01-01").cast("timestamp")
    return H.changed_triples(r.where(F.col("shipped") < since), r.where(F.col("shipped") >= since))


def _log(spark, d):  # noqa: ANN001, ANN202
    """A sign-up adds a user's key, every other event takes it away."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "added").otherwise("removed").alias("kind"), F.concat_ws("|", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("detail"))


def _reviews(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "orders").select(F.col("o_custkey").alias("target"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_orderstatus").alias("action"))


def _usage(column):  # noqa: ANN001, ANN202
    return Query(
        lambda s, d: table(s, d, "events").groupBy(F.col(column).cast("string").alias("key")).agg(
            F.count("*").alias("calls"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / 100, 2).alias("cost"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value").isNull()).alias("unpriced")
        ),
        f"""SELECT {column}::VARCHAR AS key, count(*) AS calls, round(sum(round(value * 100)::BIGINT)::BIGINT / 100, 2) AS cost, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value IS NULL) AS unpriced FROM events GROUP BY 1""",
    )


QUERIES = {
    "gov_drift": Query(lambda s, d: H.drift(_snapshot(s, d, False), _snapshot(s, d, True)), DRIFT),
    "gov_relationship_replay": Query(
        lambda s, d: H.replay(_log(s, d), ["detail"], "added"),
        """SELECT detail FROM (SELECT concat_ws('|', user_id::VARCHAR, props->>'$.k') AS detail, event_type, row_number() OVER (PARTITION BY concat_ws('|', user_id::VARCHAR, props->>'$.k') ORDER BY event_id DESC) AS rn
FROM events) WHERE rn = 1 AND event_type = 'signup'""",
    ),
    "gov_review_revert": Query(
        lambda s, d: H.before_last(_reviews(s, d)),
        """SELECT target, action AS now, before FROM (SELECT o_custkey AS target, o_orderstatus AS action, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    ),
    "agg_conflicting_evidence": Query(
        lambda s, d: H.conflicts(S.relationships(s, d).select(F.concat_ws(">", "source", "target").alias("object_id"), "confidence"), 0.8, 0.4),
        f"WITH {S.RELATIONSHIPS} SELECT source || '>' || target AS object_id, max(confidence) AS best, min(confidence) AS worst, count(*) AS n FROM rel GROUP BY 1 HAVING max(confidence) >= 0.8 AND min(confidence) <= 0.4",
    ),
    "agg_most_connected": Query(
        lambda s, d: H.most_connected(_parts(s, d), S.relationships(s, d), 25),
        f"WITH {S.RELATIONSHIPS}, d AS (SELECT source AS id, count(*) AS degree FROM rel GROUP BY 1) SELECT * FROM (SELECT 'part/' || p_partkey AS id, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON d.id = 'part/' || p_partkey ORDER BY 2 DESC, 1 LIMIT 25) WHERE degree > 0",
    ),
    "agg_most_mentioned": Query(
        lambda s, d: S.mentions(s, d).groupBy("name").agg(F.count_distinct("artifact_id").alias("documents"), F.count("*").alias("mentions")).orderBy(F.desc("documents"), F.desc("mentions"), F.lower("name"), "name").limit(25),
        f"WITH {S.MENTIONS} SELECT name, count(DISTINCT artifact_id) AS documents, count(*) AS mentions FROM m GROUP BY 1 ORDER BY 2 DESC, 3 DESC, lower(name), name LIMIT 25",
    ),
    "agg_top_by_type": Query(
        lambda s, d: S.mentions(s, d).where("kind = 'PROMO'").groupBy("name").agg(F.count_distinct("artifact_id").alias("documents"), F.max("confidence").alias("best")).orderBy(F.desc("documents"), F.desc("best"), "name").limit(10),
        f"WITH {S.MENTIONS} SELECT name, count(DISTINCT artifact_id) AS documents, max(confidence) AS best FROM m WHERE kind = 'PROMO' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10",
    ),
    "gov_relationship_counts": Query(
        lambda s, d: H.end_counts(S.relationships(s, d), "confidence < 0.3"),
        f"WITH {S.RELATIONSHIPS}, x AS (SELECT source AS id, confidence FROM rel UNION ALL SELECT target, confidence FROM rel) SELECT id, count(*) AS total, count(*) FILTER (confidence < 0.3) AS rejected FROM x GROUP BY 1",
    ),
    "gov_orphans_unlinked": Query(
        lambda s, d: H.unlinked(_parts(s, d), S.relationships(s, d)),
        f"WITH {S.RELATIONSHIPS} SELECT 'part/' || p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM rel WHERE source = 'part/' || p_partkey)",
    ),
    "gov_orphans_without_owner": Query(
        lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)",
    ),
    "gov_orphans_evidence_without_object": Query(
        lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n")),
        "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY 1",
    ),
    "gov_current_triples": Query(
        lambda s, d: S.relationships(s, d).select("source", "predicate", "target").distinct(), f"WITH {S.RELATIONSHIPS} SELECT DISTINCT source, predicate, target FROM rel"
    ),
    "gov_added_removed_triples": Query(
        _changed,
        f"""WITH {S.RELATIONSHIPS}, k AS (SELECT DISTINCT source, predicate, target FROM rel WHERE shipped < TIMESTAMP '2000-01-01'), c AS (SELECT DISTINCT source, predicate, target FROM rel WHERE shipped >= TIMESTAMP '2000-01-01')
SELECT *, 'added' AS change FROM (SELECT * FROM c EXCEPT SELECT * FROM k) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM k EXCEPT SELECT * FROM c)""",
    ),
    "gov_strongest_triple": Query(
        lambda s, d: S.relationships(s, d).groupBy("source", "predicate", "target").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n")).where("n > 1"),
        f"WITH {S.RELATIONSHIPS} SELECT source, predicate, target, max(confidence) AS confidence, count(*) AS n FROM rel GROUP BY 1, 2, 3 HAVING count(*) > 1",
    ),
    "gov_dashboard": Query(
        lambda s, d: table(s, d, "orders").agg(*[F.count_if(F.col("o_orderstatus") == x).alias(f"status_{x.lower()}") for x in "FOP"], F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.max("o_orderkey").alias("last")),
        "SELECT count(*) FILTER (o_orderstatus = 'F') AS status_f, count(*) FILTER (o_orderstatus = 'O') AS status_o, count(*) FILTER (o_orderstatus = 'P') AS status_p, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, max(o_orderkey) AS last FROM orders",
    ),
    "gov_recent_changes": Query(
        lambda s, d: table(s, d, "events").select("event_id", "event_type", "user_id").orderBy(F.desc("event_id")).limit(10), "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 10"
    ),
    "api_objects_page": Query(
        lambda s, d: (lambda n: table(s, d, "part").join(n, F.col("p_partkey") == F.col("k"), "left").where("p_type = 'SMALL'").select("p_partkey", "p_name", F.coalesce("links", F.lit(0)).alias("links")).orderBy(F.desc("links"), "p_partkey").offset(20).limit(20))(
            table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("links"))
        ),
        "SELECT p_partkey, p_name, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS links FROM part WHERE p_type = 'SMALL' ORDER BY 3 DESC, 1 LIMIT 20 OFFSET 20",
    ),
    "cost_totals": Query(
        lambda s, d: table(s, d, "events").agg(F.count("*").alias("calls"), F.round(F.coalesce(F.sum(F.round(F.col("value") * 100).cast("long")), F.lit(0)) / 100, 2).alias("cost")), "SELECT count(*) AS calls, round(coalesce(sum(round(value * 100)::BIGINT), 0)::BIGINT / 100, 2) AS cost FROM events"
    ),
    "cost_by_operation": _usage("event_type"),
    "cost_per_document": _usage("user_id"),
    "cost_vs_quality": Query(
        lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderpriority").agg(F.count("*").alias("calls"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"), F.count_distinct("l_orderkey").alias("documents")),
        "SELECT o_orderpriority, count(*) AS calls, sum(l_quantity::BIGINT)::BIGINT AS tokens, count(DISTINCT l_orderkey) AS documents FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    ),
}
