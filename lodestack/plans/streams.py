"""Queries of streams and exports over bounded input, with the batch statements that say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import exports
from lodestack.operators.graph import triples
from lodestack.plans import substrate as S
from lodestack.plans.registry import Query
from lodestack.runtime import table
from lodestack.sources import connectors
from lodestack.streaming import events as V


def _debounce(spark, d):  # noqa: ANN001, ANN202
    e = V.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = V.worked_off(V.debounced(e, "user_id", "ts", "30 minutes"))
    return out.select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


DEBOUNCE = """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS b FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, t, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM s GROUP BY user_id, k"""


def _sync(spark, d):  # noqa: ANN001, ANN202
    """The artifacts as a remote listing against an index that lacks new ones and knows older versions of the changed."""
    a = table(spark, d, "artifacts").where("path IS NOT NULL")
    listing = a.where("scan_status <> 'DELETED'").select(F.col("path").alias("remote_id"), F.lower("sha256").alias("version"), F.col("last_scanned_at").alias("modified_at"))
    known = a.where("scan_status IN ('UNCHANGED', 'DELETED')").groupBy(F.col("path").alias("remote_id")).agg(F.max(F.lower("sha256")).alias("version"))
    return connectors.sync_plan(listing, known)


SYNC = """WITH a AS (SELECT DISTINCT path, lower(sha256) AS sha, scan_status, coalesce(last_scanned_at, '') AS t FROM artifacts WHERE path IS NOT NULL),
l AS (SELECT path, arg_max(sha, t) AS now FROM (SELECT * FROM a WHERE scan_status <> 'DELETED' AND sha IS NOT NULL) GROUP BY 1), l2 AS (SELECT DISTINCT x.path, l.now FROM (SELECT path FROM a WHERE scan_status <> 'DELETED') x LEFT JOIN l ON x.path = l.path),
k AS (SELECT path, max(sha) AS was FROM a WHERE scan_status IN ('UNCHANGED', 'DELETED') GROUP BY 1)
SELECT coalesce(l2.path, k.path) AS remote_id, CASE WHEN l2.path IS NULL THEN 'drop' WHEN k.path IS NOT NULL AND now IS NOT DISTINCT FROM was THEN 'keep' ELSE 'fetch' END AS action FROM l2 FULL JOIN k ON l2.path = k.path"""

QUERIES = {
    "stream_debounce": Query(_debounce, DEBOUNCE),
    "stream_status_counts": Query(
        lambda s, d: V.worked_off(V.status_counts(V.table_stream(s, d, "events"), "event_type")), "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1"
    ),
    "source_sync_plan": Query(_sync, SYNC),
    "export_n_triples": Query(
        lambda s, d: exports.n_triples(triples(S.vertices(s, d), S.hierarchy(s, d)).where("p <> 'confidence'"), ["label"]),
        f"""WITH {S.VERTICES}, {S.HIERARCHY}, t AS (SELECT id AS s, 'type' AS p, kind AS o FROM v UNION SELECT id, 'label', label FROM v UNION SELECT * FROM h)
SELECT '<https://kg.example/' || s || '> <https://kg.example/' || p || '> ' || CASE WHEN p = 'label' THEN '"' || o || '"' ELSE '<https://kg.example/' || replace(o, ' ', '_') || '>' END || ' .' AS value FROM t""",
    ),
}
