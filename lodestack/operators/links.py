"""Links: canonical keys and the changes between link scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.snapshots import snapshot_changes

LINK_VALUES = ["status", "target_system", "target_type", "link_kind"]


#: White space that may surround a key.
BLANKS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def url_key(url: Column) -> Column:
    """The address without surrounding white space; scheme and host of http(s) addresses in lower case. No regular expressions: it runs on every row."""
    url = stripped(url)
    start = F.lower(F.substring(url, 1, 8))
    head = url
    for mark, n in (("/", 3), ("?", 1), ("#", 1)):
        head = F.substring_index(head, mark, n)
    return F.when(start.startswith("http://") | (start == "https://"), F.concat(F.lower(head), F.substring(url, F.length(head) + 1, F.length(url)))).otherwise(url)


def link_changes(links: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, source_artifact_id, normalized_url, anchor_text, change_kind; see snapshot_changes. last_seen_at alone is no change."""
    keys = {
        "source_artifact_id": stripped(F.col("source_artifact_id")),
        "normalized_url": url_key(F.col("normalized_url")),
        "anchor_text": stripped(F.coalesce("anchor_text", F.lit(""))),
    }
    return snapshot_changes(links, runs.select("id", F.col("scan_root").alias("root"), "started_at", "completed_at"), keys, LINK_VALUES)


def removal_report(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run with a predecessor: the changes found and whether its links_removed tells the truth (NULL when it says nothing)."""
    n = lambda kind: F.count_if(F.col("change_kind") == kind).alias(kind)
    counted = changes.groupBy("run_id").agg(n("added"), n("removed"), n("changed"))
    said = runs.where(F.col("completed_at").isNotNull()).groupBy(F.col("id").alias("run_id")).agg(F.max("scan_root").alias("scan_root"), F.max("links_removed").alias("said_removed"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = said.join(counted, "run_id", "left").select("run_id", "scan_root", zero("added"), zero("removed"), zero("changed"), "said_removed")
    return out.withColumn("truthful", F.col("said_removed") == F.col("removed"))


def link_rows(links: DataFrame) -> DataFrame:
    """The links with null-safe keys: source_artifact_id, normalized_url, anchor ('' for NULL)."""
    return links.withColumn("anchor", F.coalesce("anchor_text", F.lit("")))


def upsert_links(prior: DataFrame, seen: DataFrame, scanned: DataFrame) -> DataFrame:
    """The link store after a scan. prior and seen: key columns, raw_url, first_seen, last_seen (seen: one row per key); scanned: artifacts the scan read.

    A link seen now is ACTIVE with its raw_url of now and its old first_seen; a known link of a scanned artifact that wasn't seen is STALE;
    links of other artifacts stay as they are. Null-safe keys come from link_rows.
    """
    keys = ["source_artifact_id", "normalized_url", "anchor"]
    a = prior.select(*keys, F.struct("raw_url", "first_seen", "last_seen", "status").alias("a"))
    b = seen.select(*keys, F.struct("raw_url", F.col("first_seen"), F.col("last_seen")).alias("b"))
    j = a.join(b, keys, "full").join(scanned.select("source_artifact_id").distinct().withColumn("read", F.lit(True)), "source_artifact_id", "left")
    now = F.col("b").isNotNull()
    return j.select(
        *keys,
        F.when(now, F.col("b.raw_url")).otherwise(F.col("a.raw_url")).alias("raw_url"),
        F.coalesce("a.first_seen", "b.first_seen").alias("first_seen"),
        F.when(now, F.col("b.last_seen")).otherwise(F.col("a.last_seen")).alias("last_seen"),
        F.when(now, "ACTIVE").when(F.col("read"), "STALE").otherwise(F.col("a.status")).alias("status"),
    )


# Links as prose and Markdown hold them.
MARKDOWN = r"\[([^\]]+)\]\(([^)\s]+)\)"
BARE = r"(?i)(?:https?|file|mailto):[^\s)\]>\"']+"


def extract_links(texts: DataFrame, key: str) -> DataFrame:
    """key, raw_url, anchor_text, position: Markdown links first, then bare addresses; the first sight of an address in a text counts."""
    anchors, urls = F.regexp_extract_all("text", F.lit(MARKDOWN), 1), F.regexp_extract_all("text", F.lit(MARKDOWN), 2)
    marked = F.transform(F.arrays_zip(anchors.alias("a"), urls.alias("u")), lambda x: F.struct(x["u"].alias("raw_url"), x["a"].alias("anchor_text")))
    marked = F.filter(marked, lambda x: x["raw_url"].rlike(r"^(?i)(?:https?|file|mailto):"))
    bare = F.transform(F.regexp_extract_all("text", F.lit(BARE), 0), lambda u: F.struct(u.alias("raw_url"), F.lit(None).cast("string").alias("anchor_text")))
    each = texts.where(F.col("text").isNotNull()).select(key, F.posexplode(F.concat(marked, bare)).alias("position", "x"))
    return each.groupBy(key, F.col("x.raw_url").alias("raw_url")).agg(F.min_by("x.anchor_text", "position").alias("anchor_text"), F.min("position").alias("position"))
