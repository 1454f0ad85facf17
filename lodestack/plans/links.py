"""Queries over links and their scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import urls
from lodestack.operators import links as L
from lodestack.operators.scan import latest, page
from lodestack.plans.registry import Query
from lodestack.runtime import table


def _changes(spark, d):  # noqa: ANN001, ANN202
    return L.link_changes(table(spark, d, "links"), table(spark, d, "link_scan_runs"))


def _report(spark, d):  # noqa: ANN001, ANN202
    return L.removal_report(_changes(spark, d), table(spark, d, "link_scan_runs"))


P4_SQL = r"""
WITH r AS (SELECT DISTINCT id, scan_root, started_at FROM link_scan_runs WHERE completed_at IS NOT NULL),
s AS (SELECT id, scan_root, row_number() OVER (PARTITION BY scan_root ORDER BY started_at, id) AS n FROM r),
k AS (SELECT run_id, regexp_replace(source_artifact_id, '^\s+|\s+$', '', 'g') AS a,
  regexp_replace(normalized_url, '^\s+|\s+$', '', 'g') AS u0, regexp_replace(coalesce(anchor_text, ''), '^\s+|\s+$', '', 'g') AS t,
  status, target_system, target_type, link_kind, last_seen_at FROM links),
h AS (SELECT *, regexp_extract(u0, '^(?i)https?://[^/?#]*') AS head FROM k),
l AS (SELECT *, row_number() OVER (PARTITION BY run_id, a, u, t ORDER BY last_seen_at DESC NULLS LAST, status, target_system, target_type, link_kind) AS rn
  FROM (SELECT *, lower(head) || substr(u0, length(head) + 1) AS u FROM h)),
x AS (SELECT s.scan_root, s.n, s.id, l.* FROM l JOIN s ON l.run_id = s.id WHERE rn = 1),
p AS (SELECT b.id AS new_id, b.scan_root, b.n FROM s b WHERE b.n > 1),
new AS (SELECT p.new_id, x.a, x.u, x.t, x.status, x.target_system, x.target_type, x.link_kind FROM p JOIN x ON x.scan_root = p.scan_root AND x.n = p.n),
old AS (SELECT p.new_id, x.a, x.u, x.t, x.status, x.target_system, x.target_type, x.link_kind FROM p JOIN x ON x.scan_root = p.scan_root AND x.n = p.n - 1)
SELECT coalesce(n.new_id, o.new_id) AS run_id, coalesce(n.a, o.a) AS source_artifact_id, coalesce(n.u, o.u) AS normalized_url, coalesce(n.t, o.t) AS anchor_text,
  CASE WHEN o.new_id IS NULL THEN 'added' WHEN n.new_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new n FULL JOIN old o ON n.new_id = o.new_id AND n.a = o.a AND n.u = o.u AND n.t = o.t
WHERE o.new_id IS NULL OR n.new_id IS NULL OR n.status IS DISTINCT FROM o.status OR n.target_system IS DISTINCT FROM o.target_system
  OR n.target_type IS DISTINCT FROM o.target_type OR n.link_kind IS DISTINCT FROM o.link_kind
"""

P4_REPORT_SQL = f"""
WITH c AS ({P4_SQL}), n AS (SELECT run_id, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed,
  count(*) FILTER (change_kind = 'changed') AS changed FROM c GROUP BY run_id),
r AS (SELECT id AS run_id, max(scan_root) AS scan_root, max(links_removed) AS said_removed FROM link_scan_runs WHERE completed_at IS NOT NULL GROUP BY id)
SELECT r.run_id, scan_root, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(changed, 0) AS changed, said_removed,
  said_removed = coalesce(removed, 0) AS truthful FROM r LEFT JOIN n ON r.run_id = n.run_id
"""

URL_PARTS = r"""SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS host,
  regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(u, '^[^#]*#(.*)$', 1) AS fragment"""

NORMAL_SQL = rf"""
WITH r AS (SELECT DISTINCT raw_url, rtrim(trim(raw_url), '.,;:!?”’"'')]}}>') AS u FROM links WHERE raw_url IS NOT NULL),
p AS ({URL_PARTS} FROM r),
q AS (SELECT *, array_to_string(list_transform(list_filter(string_split(query, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content')),
  lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS kept,
  regexp_matches(u, '^(?i)(file:|/|\\\\|[a-z]:[\\/])') AS is_local, replace(u, '\', '/') AS f FROM p)
SELECT raw_url, CASE
  WHEN starts_with(lower(u), 'mailto:') THEN 'mailto:' || array_to_string(list_transform(list_filter(string_split(split_part(substr(u, 8), '?', 1), ','), lambda x: trim(x) <> ''), lambda x: lower(trim(url_decode(x)))), ',')
  WHEN is_local AND starts_with(lower(f), 'file:') THEN 'file://' || lower(regexp_extract(f, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) || regexp_extract(f, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)
  WHEN is_local AND regexp_matches(f, '^[A-Za-z]:/') THEN 'file:///' || f WHEN is_local THEN 'file://' || f
  WHEN scheme = '' THEN u
  ELSE scheme || ':' || CASE WHEN host <> '' THEN '//' || host ELSE '' END || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END
    || CASE WHEN starts_with(fragment, '!') OR contains(fragment, '/') OR contains(fragment, '=') THEN '#' || fragment ELSE '' END END AS normalized FROM q
"""

CLASS_SQL = rf"""
WITH r AS (SELECT DISTINCT regexp_replace(normalized_url, '^\s+|\s+$', '', 'g') AS u FROM links WHERE normalized_url IS NOT NULL), p AS ({URL_PARTS} FROM r),
l AS (SELECT *, lower(path) AS w, regexp_matches(lower(path), '\.(docx|doc|xlsx|xls|pptx|ppt|pdf|md|txt)$') AS doc FROM p),
s AS (SELECT *, CASE
  WHEN starts_with(lower(trim(u)), 'mailto:') THEN 'email' WHEN regexp_matches(trim(u), '^(?i)(file:|/|\\\\|[a-z]:[\\/])') THEN 'local_file' WHEN host = '' THEN 'unknown'
  WHEN contains(host, 'onedrive.live.com') OR contains(host, '1drv.ms') OR contains(host, 'my.sharepoint.com') THEN 'onedrive'
  WHEN contains(host, 'sharepoint.com') OR regexp_matches(w, '/sites/|/:[wxp]:/') THEN 'sharepoint'
  WHEN contains(host, 'dev.azure.com') OR contains(host, 'visualstudio.com') OR regexp_matches(w, '_workitems|_git|_wiki|pullrequest') THEN 'azure_devops'
  WHEN (starts_with(host, 'jira.') OR contains(host, '.jira.') OR contains(host, 'atlassian.net')) AND regexp_matches(w, '/browse/|/jira/') THEN 'jira'
  WHEN starts_with(host, 'confluence.') OR contains(host, '.confluence.') OR regexp_matches(w, '/wiki/|/display/') THEN 'confluence'
  WHEN host = 'github.com' OR ends_with(host, '.github.com') THEN 'github'
  WHEN contains(host, 'teams.microsoft.com') OR regexp_matches(w, '/l/(message|channel|meetup-join)/') THEN 'teams' ELSE 'external_web' END AS system FROM l)
SELECT u AS normalized_url, system AS target_system, CASE
  WHEN system = 'email' THEN 'email_address'
  WHEN system IN ('sharepoint', 'onedrive') THEN CASE WHEN doc OR regexp_matches(w, '/:[wxp]:/') THEN 'document' WHEN contains(w, '/personal/') AND (ends_with(w, '/') OR contains(w, '/documents')) THEN 'folder' ELSE 'document' END
  WHEN system = 'azure_devops' THEN CASE WHEN contains(w, '_workitems') THEN 'work_item' WHEN contains(w, 'pullrequest') THEN 'pull_request' WHEN contains(w, '_git') THEN 'repository' WHEN contains(w, '_wiki') THEN 'wiki_page' ELSE 'unknown' END
  WHEN system = 'github' THEN CASE WHEN contains(w, '/pull/') THEN 'pull_request' WHEN len(list_filter(string_split(w, '/'), lambda x: x <> '')) >= 2 THEN 'repository' ELSE 'unknown' END
  WHEN system = 'teams' THEN CASE WHEN contains(w, '/l/message/') THEN 'message' WHEN contains(w, '/l/channel/') THEN 'channel' WHEN contains(w, '/l/meetup-join/') THEN 'meeting' ELSE 'unknown' END
  WHEN system = 'confluence' THEN 'wiki_page' WHEN system = 'jira' THEN 'work_item'
  WHEN system = 'local_file' THEN CASE WHEN doc THEN 'document' WHEN ends_with(u, '/') THEN 'folder' ELSE 'unknown' END
  WHEN system = 'external_web' AND doc THEN 'document' ELSE 'unknown' END AS target_type,
  CASE WHEN system = 'email' THEN 'email' WHEN system = 'local_file' THEN 'local'
  WHEN contains(lower(host || path), 'corvane.example') OR system IN ('sharepoint', 'onedrive', 'confluence', 'jira', 'azure_devops', 'teams') THEN 'internal'
  WHEN system IN ('github', 'external_web') THEN 'external' ELSE 'unknown' END AS link_kind FROM s
"""

RUNS_SQL = """WITH r AS (SELECT DISTINCT id, scan_root, started_at FROM link_scan_runs WHERE completed_at IS NOT NULL),
s AS (SELECT id, row_number() OVER (PARTITION BY scan_root ORDER BY started_at DESC, id DESC) AS back FROM r),
l AS (SELECT l.*, back FROM links l JOIN s ON l.run_id = s.id WHERE back <= 2),
k AS (SELECT * FROM (SELECT *, coalesce(anchor_text, '') AS anchor, row_number() OVER (PARTITION BY back, source_artifact_id, normalized_url, coalesce(anchor_text, '') ORDER BY last_seen_at DESC NULLS LAST, raw_url DESC NULLS LAST) AS rn FROM l) WHERE rn = 1)"""


def _two(spark, d):  # noqa: ANN001, ANN202
    """The links of each root's last completed run (back 1) and of the one before it (back 2), one row per key."""
    from pyspark.sql import Window

    runs = table(spark, d, "link_scan_runs").where("completed_at IS NOT NULL").select("id", "scan_root", "started_at").distinct()
    back = F.row_number().over(Window.partitionBy("scan_root").orderBy(F.desc("started_at"), F.desc("id")))
    runs = runs.select(F.col("id").alias("run_id"), back.alias("back")).where("back <= 2")
    rows = L.link_rows(table(spark, d, "links").join(runs, "run_id"))
    return latest(rows, ["back", "source_artifact_id", "normalized_url", "anchor"], F.col("last_seen_at"), F.col("raw_url"))


def _upsert(spark, d):  # noqa: ANN001, ANN202
    k = _two(spark, d)
    cols = ["source_artifact_id", "normalized_url", "anchor", "raw_url", F.col("discovered_at").alias("first_seen"), F.col("last_seen_at").alias("last_seen")]
    seen = k.where("back = 1").select(*cols)
    out = L.upsert_links(k.where("back = 2").select(*cols, F.lit("ACTIVE").alias("status")), seen, seen)
    return out.withColumns({c: F.unix_micros(c) for c in ("first_seen", "last_seen")})


def _current(spark, d):  # noqa: ANN001, ANN202
    return _two(spark, d).where("back = 1")


def _classes(spark, d):  # noqa: ANN001, ANN202
    u = F.col("normalized_url")
    rows = table(spark, d, "links").where(u.isNotNull()).select(L.stripped(u).alias("normalized_url")).distinct().withColumn("target_system", urls.target_system(u))
    return rows.select(u, "target_system", urls.target_type(u, F.col("target_system")).alias("target_type"), urls.link_kind(u, F.col("target_system"), ["corvane.example"]).alias("link_kind"))


def _counts(column):  # noqa: ANN001, ANN202
    return Query(
        lambda s, d: _current(s, d).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")),
        f"{RUNS_SQL} SELECT {column} AS key, count(*) AS n FROM k WHERE back = 1 GROUP BY 1",
    )


QUERIES = {
    "link_normalize": Query(
        lambda s, d: table(s, d, "links").where("raw_url IS NOT NULL").select("raw_url").distinct().select("raw_url", urls.normalize_url(F.col("raw_url")).alias("normalized")), NORMAL_SQL
    ),
    "link_classify": Query(_classes, CLASS_SQL),
    "link_counts_system": _counts("target_system"),
    "link_counts_type": _counts("target_type"),
    "link_counts_kind": _counts("link_kind"),
    "link_counts_status": _counts("status"),
    "link_top_urls": Query(
        lambda s, d: _current(s, d).groupBy("normalized_url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "normalized_url").limit(20),
        f"{RUNS_SQL} SELECT normalized_url, count(*) AS n FROM k WHERE back = 1 GROUP BY 1 ORDER BY n DESC, normalized_url LIMIT 20",
    ),
    "link_top_artifacts": Query(
        lambda s, d: _current(s, d).groupBy("source_artifact_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_artifact_id").limit(20),
        f"{RUNS_SQL} SELECT source_artifact_id, count(*) AS n FROM k WHERE back = 1 GROUP BY 1 ORDER BY n DESC, source_artifact_id LIMIT 20",
    ),
    "link_upsert_stale": Query(
        _upsert,
        f"""{RUNS_SQL}, n AS (SELECT * FROM k WHERE back = 1), o AS (SELECT * FROM k WHERE back = 2), read AS (SELECT DISTINCT source_artifact_id FROM n)
SELECT coalesce(n.source_artifact_id, o.source_artifact_id) AS source_artifact_id, coalesce(n.normalized_url, o.normalized_url) AS normalized_url, coalesce(n.anchor, o.anchor) AS anchor,
CASE WHEN n.run_id IS NULL THEN o.raw_url ELSE n.raw_url END AS raw_url, epoch_us(coalesce(o.discovered_at, n.discovered_at)) AS first_seen, epoch_us(CASE WHEN n.run_id IS NULL THEN o.last_seen_at ELSE n.last_seen_at END) AS last_seen,
CASE WHEN n.run_id IS NOT NULL THEN 'ACTIVE' WHEN coalesce(n.source_artifact_id, o.source_artifact_id) IN (SELECT source_artifact_id FROM read) THEN 'STALE' ELSE 'ACTIVE' END AS status
FROM n FULL JOIN o ON n.source_artifact_id = o.source_artifact_id AND n.normalized_url = o.normalized_url AND n.anchor = o.anchor""",
    ),
    "link_stale": Query(
        lambda s, d: _current(s, d).where("status = 'STALE'").select("source_artifact_id", "normalized_url", "anchor"),
        f"{RUNS_SQL} SELECT source_artifact_id, normalized_url, anchor FROM k WHERE back = 1 AND status = 'STALE'",
    ),
    "link_for_system_page": Query(
        lambda s, d: page(_current(s, d).where("target_system = 'jira'").select("source_artifact_id", "normalized_url", "anchor"), [F.asc("source_artifact_id"), F.asc("normalized_url"), F.asc("anchor")], 50, 50),
        f"""{RUNS_SQL}, f AS (SELECT source_artifact_id, normalized_url, anchor FROM k WHERE back = 1 AND target_system = 'jira')
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY 1, 2, 3 LIMIT 50 OFFSET 50""",
    ),
    "link_extract": Query(
        lambda s, d: L.extract_links(table(s, d, "links").select(F.col("run_id").alias("k"), F.concat(F.lit("see ["), F.coalesce("anchor_text", F.lit("it")), F.lit("]("), F.regexp_replace("raw_url", r"\\s+", ""), F.lit(") or "), F.regexp_replace("raw_url", r"\\s+", ""), F.lit(" now")).alias("text")), "k").select("k", "raw_url"),
        """WITH t AS (SELECT run_id AS k, 'see [' || coalesce(anchor_text, 'it') || '](' || regexp_replace(raw_url, '\\s+', '', 'g') || ') or ' || regexp_replace(raw_url, '\\s+', '', 'g') || ' now' AS text FROM links)
SELECT DISTINCT k, raw_url FROM (SELECT k, unnest(list_filter(regexp_extract_all(text, '\\[([^\\]]+)\\]\\(([^)\\s]+)\\)', 2), lambda x: regexp_matches(x, '^(?i)(?:https?|file|mailto):'))) AS raw_url FROM t
UNION ALL SELECT k, unnest(regexp_extract_all(text, '(?i)(?:https?|file|mailto):[^\\s)\\]>"'']+')) FROM t)""",
    ),
    "p4_found": Query(_changes, P4_SQL),
    "p4_removal_report": Query(_report, P4_REPORT_SQL),
}
