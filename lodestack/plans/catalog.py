"""Queries over the scanned files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import names, times
from lodestack.operators import scan
from lodestack.plans.registry import Query
from lodestack.runtime import table

STATES = ["RAW", "UNCHANGED", "CHANGED", "DELETED", "DUPLICATE"]
NOW = "2025-06-01T00:00:00+00:00"


def files(spark, d):  # noqa: ANN001, ANN202
    """The latest row of each path, hash and type in lower case."""
    rows = scan.latest(table(spark, d, "artifacts").where(F.col("path").isNotNull()), ["path"], F.col("last_scanned_at"), F.col("id"))
    return rows.withColumns({"sha256": F.lower("sha256"), "file_type": F.lower("file_type")})


FILES = """files AS (SELECT path, id, filename, lower(file_type) AS file_type, size_bytes, created_at, modified_at, lower(sha256) AS sha256, source_system,
  scan_status, first_seen_at, last_scanned_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_scanned_at DESC NULLS LAST, id DESC NULLS LAST) AS rn
  FROM (SELECT DISTINCT * FROM artifacts WHERE path IS NOT NULL)) WHERE rn = 1)"""


def _diff(spark, d):  # noqa: ANN001, ANN202
    """The files as they are now against an index in which new files are missing and changed ones had another hash."""
    f = files(spark, d)
    gone = F.coalesce(F.col("scan_status"), F.lit("")) == "DELETED"
    now = f.where(~gone).select("path", "sha256", F.col("last_scanned_at").alias("seen_at"))
    was = f.where(F.coalesce("scan_status", F.lit("")) != "RAW").select("path", F.when(F.col("scan_status") == "CHANGED", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"), "first_seen_at")
    return scan.diff(now, was)


DIFF = f"""{FILES}, cur AS (SELECT path, sha256, last_scanned_at AS seen_at FROM files WHERE coalesce(scan_status, '') <> 'DELETED'),
was AS (SELECT path, CASE WHEN scan_status = 'CHANGED' THEN reverse(sha256) ELSE sha256 END AS sha256, first_seen_at FROM files WHERE coalesce(scan_status, '') <> 'RAW'),
found AS (SELECT coalesce(c.path, w.path) AS path, CASE WHEN c.path IS NULL THEN w.sha256 ELSE c.sha256 END AS sha256,
  CASE WHEN c.path IS NULL THEN 'DELETED' WHEN w.path IS NULL THEN 'RAW' WHEN c.sha256 IS NOT DISTINCT FROM w.sha256 THEN 'UNCHANGED' ELSE 'CHANGED' END AS status,
  coalesce(first_seen_at, seen_at) AS first_seen_at FROM cur c FULL JOIN was w ON c.path = w.path)"""


def _upserted(spark, d):  # noqa: ANN001, ANN202
    """Files of the older half of the scans, with those of the newer half put in."""
    f = files(spark, d).select("path", "id", "sha256", "first_seen_at", "last_scanned_at")
    rows = table(spark, d, "artifacts").where("path IS NOT NULL").select("path", "id", F.lower("sha256").alias("sha256"), "first_seen_at", "last_scanned_at")
    old = scan.latest(rows.where("last_scanned_at < '2025'"), ["path"], F.col("last_scanned_at"), F.col("id"))
    return scan.upsert(old, f.where("last_scanned_at >= '2025'"), ["path"], ["first_seen_at"])


UPSERT = f"""WITH {FILES}, old AS (SELECT * FROM (SELECT path, id, lower(sha256) AS sha256, first_seen_at, last_scanned_at,
  row_number() OVER (PARTITION BY path ORDER BY last_scanned_at DESC NULLS LAST, id DESC NULLS LAST) AS rn FROM (SELECT DISTINCT * FROM artifacts WHERE path IS NOT NULL AND last_scanned_at < '2025')) WHERE rn = 1),
new AS (SELECT * FROM files WHERE last_scanned_at >= '2025')
SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN o.id ELSE n.id END AS id, CASE WHEN n.path IS NULL THEN o.sha256 ELSE n.sha256 END AS sha256,
  coalesce(o.first_seen_at, n.first_seen_at) AS first_seen_at, CASE WHEN n.path IS NULL THEN o.last_scanned_at ELSE n.last_scanned_at END AS last_scanned_at
FROM old o FULL JOIN new n ON o.path = n.path"""


def _scope(spark, d):  # noqa: ANN001, ANN202
    roots = spark.createDataFrame([("/vault/ws_000/",), ("/vault/ws_001/inbox",)], "root string")
    curated = table(spark, d, "compliance_assessment_evidence").where("artifact_id IS NOT NULL").select(F.col("artifact_id").alias("id"))
    return scan.in_scope(files(spark, d), roots, curated)


def _growth(interval):  # noqa: ANN001, ANN202
    def run(spark, d):  # noqa: ANN001, ANN202
        f = files(spark, d).where("coalesce(scan_status, '') <> 'DELETED'").select(F.lit("artifact").alias("kind"), times.moment(F.col("first_seen_at")).alias("t"))
        o = table(spark, d, "orders").select(F.lit("object").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("t"))
        e = table(spark, d, "events").select(F.lit("relationship").alias("kind"), F.col("ts").cast("timestamp").alias("t"))
        s = f.unionByName(o).unionByName(e).where("t IS NOT NULL").withColumn("period", times.period(F.col("t"), interval)).groupBy("kind", "period").agg(F.count("*").alias("added"))
        return scan.running_totals(s, 12)

    return run


ISO = r"'^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$'"


def moment_sql(c: str) -> str:
    """Times without a zone are in UTC."""
    zoned = f"regexp_matches({c}, '(Z|[+-]\\d{{2}}:\\d{{2}})$') AND length({c}) > 10"
    return f"CASE WHEN regexp_full_match({c}, {ISO}) THEN CASE WHEN {zoned} THEN TRY_CAST({c} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE TRY_CAST({c} AS TIMESTAMP) END END"


def _growth_sql(fmt: str) -> str:
    return f"""WITH {FILES}, s AS (SELECT 'artifact' AS kind, {moment_sql('first_seen_at')} AS t FROM files WHERE coalesce(scan_status, '') <> 'DELETED'
UNION ALL SELECT 'object', CAST(o_orderdate AS TIMESTAMP) FROM orders UNION ALL SELECT 'relationship', CAST(ts AS TIMESTAMP) FROM events),
p AS (SELECT kind, strftime(t, '{fmt}') AS period, count(*) AS added FROM s WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT kind, period, added, total FROM (SELECT *, sum(added) OVER (PARTITION BY kind ORDER BY period)::BIGINT AS total, row_number() OVER (PARTITION BY kind ORDER BY period DESC) AS b FROM p) WHERE b <= 12"""


def _page(spark, d):  # noqa: ANN001, ANN202
    """Classified PDF files whose path holds 'inbox', second page of ten."""
    done = table(spark, d, "document_classifications").select(F.col("artifact_id").alias("id")).distinct()
    f = files(spark, d).where("file_type = 'pdf'").where(F.lower("path").contains("inbox")).join(done, "id", "left_semi")
    return scan.page(f.select("path", "id", "size_bytes", "scan_status"), [F.asc("path")], 10, 10)


QUERIES = {
    "scan_latest": Query(lambda s, d: files(s, d).select("path", "id", "file_type", "sha256", "scan_status", "size_bytes"), f"WITH {FILES} SELECT path, id, file_type, sha256, scan_status, size_bytes FROM files"),
    "scan_duplicates": Query(
        lambda s, d: scan.duplicate_report(files(s, d)),
        f"WITH {FILES} SELECT sha256, count(*) AS n, string_agg(path, '; ' ORDER BY path) AS paths FROM files WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1",
    ),
    "scan_diff": Query(_diff, f"WITH {DIFF} SELECT path, sha256, status, first_seen_at FROM found"),
    "scan_flag_duplicates": Query(
        lambda s, d: scan.flag_duplicates(_diff(s, d)).select("path", "status", "is_duplicate"),
        f"""WITH {DIFF}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY (status = 'RAW'), path) AS rn FROM found)
SELECT path, status, sha256 IS NOT NULL AND rn > 1 AND status <> 'DELETED' AS is_duplicate FROM r""",
    ),
    "scan_stats": Query(
        lambda s, d: scan.status_counts(_diff(s, d), ["RAW", "UNCHANGED", "CHANGED", "DELETED"]),
        f"""WITH {DIFF} SELECT count(*) FILTER (status = 'RAW') AS raw, count(*) FILTER (status = 'UNCHANGED') AS unchanged, count(*) FILTER (status = 'CHANGED') AS changed,
count(*) FILTER (status = 'DELETED') AS deleted, count(*) AS discovered FROM found""",
    ),
    "scan_upsert": Query(_upserted, UPSERT),
    "scan_id_matches_hash": Query(
        lambda s, d: files(s, d).withColumn("ok", names.content_id(F.col("sha256")) == F.col("id")).groupBy("ok").agg(F.count("*").alias("n")),
        f"WITH {FILES} SELECT 'doc_' || substr(sha256, 1, 12) = id AS ok, count(*) AS n FROM files GROUP BY 1",
    ),
    "scan_scope": Query(
        _scope,
        f"""WITH {FILES} SELECT id FROM files WHERE scan_status IS DISTINCT FROM 'DELETED' AND (path = '/vault/ws_000' OR starts_with(path, '/vault/ws_000/') OR path = '/vault/ws_001/inbox' OR starts_with(path, '/vault/ws_001/inbox/'))
UNION SELECT artifact_id FROM compliance_assessment_evidence WHERE artifact_id IS NOT NULL""",
    ),
    "scan_purge_plan": Query(
        lambda s, d: scan.purge_plan(files(s, d), "/vault/ws_000"),
        f"""WITH {FILES}, u AS (SELECT id, path = '/vault/ws_000' OR starts_with(path, '/vault/ws_000/') AS x FROM files)
SELECT id, count(*) FILTER (x) AS paths_under, count(*) FILTER (NOT x) AS paths_elsewhere, count(*) FILTER (NOT x) = 0 AS exclusive FROM u GROUP BY id HAVING count(*) FILTER (x) > 0""",
    ),
    "scan_live_ids": Query(
        lambda s, d: files(s, d).where("scan_status IS DISTINCT FROM 'DELETED'").select("id").union(table(s, d, "compliance_assessment_evidence").where("artifact_id IS NOT NULL").select("artifact_id")).distinct(),
        f"WITH {FILES} SELECT id FROM files WHERE scan_status IS DISTINCT FROM 'DELETED' UNION SELECT artifact_id FROM compliance_assessment_evidence WHERE artifact_id IS NOT NULL",
    ),
    "list_artifacts_page": Query(
        _page,
        f"""WITH {FILES}, f AS (SELECT path, id, size_bytes, scan_status FROM files WHERE file_type = 'pdf' AND contains(lower(path), 'inbox') AND id IN (SELECT artifact_id FROM document_classifications))
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY path LIMIT 10 OFFSET 10""",
    ),
    "list_unclassified_artifacts": Query(
        lambda s, d: files(s, d).join(table(s, d, "document_classifications").select(F.col("artifact_id").alias("id")).distinct(), "id", "left_anti").select("path", "id"),
        f"WITH {FILES} SELECT path, id FROM files f WHERE NOT EXISTS (SELECT 1 FROM document_classifications c WHERE c.artifact_id = f.id)",
    ),
    "agg_growth_month": Query(_growth("month"), _growth_sql("%Y-%m")),
    "agg_growth_week": Query(_growth("week"), _growth_sql("%Y-W%W")),
    "agg_growth_day": Query(_growth("day"), _growth_sql("%Y-%m-%d")),
    "fn_age_freshness": Query(
        lambda s, d: (lambda a: files(s, d).select("path", F.round(a, 4).alias("age_days"), times.freshness(a).alias("freshness"), times.freshness_state(a).alias("state")))(
            times.age_days(times.moment(F.col("last_scanned_at")), F.to_timestamp(F.lit(NOW)))
        ),
        f"""WITH {FILES}, a AS (SELECT path, greatest(0, coalesce((epoch_us(TIMESTAMP '2025-06-01') - epoch_us({moment_sql('last_scanned_at')})) / 86400000000, 0)) AS age FROM files)
SELECT path, round(age, 4) AS age_days, round(greatest(0, least(1, 1 - age / 730)), 3) AS freshness, CASE WHEN age >= 365 THEN 'STALE' WHEN age >= 180 THEN 'AGING' ELSE 'FRESH' END AS state FROM a""",
    ),
}
