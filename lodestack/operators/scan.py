"""Change detection over scanned files: latest rows, diffs, duplicates, upserts and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.runtime import broadcast_if_small


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of the rows of a key the one with the greatest order; NULL is least. A combining aggregate, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def diff(current: DataFrame, prior: DataFrame) -> DataFrame:
    """path, sha256, status, first_seen_at. current: path, sha256, seen_at; prior: path, sha256, first_seen_at. One full outer join.

    RAW: new path; UNCHANGED or CHANGED by hash (NULL equals NULL); DELETED: the path is gone, its old hash stays.
    """
    c, p = current.select("path", F.col("sha256").alias("now"), "seen_at", F.lit(True).alias("here")), prior.select("path", F.col("sha256").alias("was"), "first_seen_at", F.lit(True).alias("there"))
    j = c.join(p, "path", "full")
    status = F.when(F.col("here").isNull(), "DELETED").when(F.col("there").isNull(), "RAW").when(F.col("now").eqNullSafe(F.col("was")), "UNCHANGED").otherwise("CHANGED")
    return j.select("path", F.when(F.col("here").isNull(), F.col("was")).otherwise(F.col("now")).alias("sha256"), status.alias("status"), F.coalesce("first_seen_at", "seen_at").alias("first_seen_at"))


def flag_duplicates(found: DataFrame) -> DataFrame:
    """found plus is_duplicate: all rows of a hash but its primary, which is a known path before a new one, then the least path.

    The primary is found by an aggregate and joined, so that a hash on a third of all rows sorts nowhere. NULL hashes are no duplicates.
    """
    place = F.struct((F.col("status") == "RAW").alias("new"), F.col("path").alias("path"))
    first = found.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.min(place).alias("first"))
    j = found.join(first, "sha256", "left")
    return j.select(*found.columns, F.coalesce((F.col("path") != F.col("first.path")) & (F.col("status") != "DELETED"), F.lit(False)).alias("is_duplicate"))


def duplicate_report(files: DataFrame) -> DataFrame:
    """sha256, n, paths (sorted, joined) of hashes on more than one path."""
    return files.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), "; ").alias("paths")).where("n > 1")


def status_counts(found: DataFrame, kinds: list[str], column: str = "status") -> DataFrame:
    """One row with a counter for each status, and all rows."""
    return found.agg(*[F.count_if(F.col(column) == k).alias(k.lower()) for k in kinds], F.count("*").alias("discovered"))


def upsert(prior: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """prior with the rows of new put in by key: new values win, but for the columns to keep, which stay once set. Keys are matched null-safe."""
    cols = [c for c in prior.columns if c not in keys]
    a = prior.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.struct(*cols).alias("a"), F.lit(True).alias("in_a"))
    b = new.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.struct(*cols).alias("b"), F.lit(True).alias("in_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    j = a.join(b, same, "full")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in keep else F.when(F.col("in_b"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return j.select(*[F.when(F.col("in_a"), F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in keys], *[pick(c).alias(c) for c in cols])


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def under(path: Column, root: str) -> Column:
    """The path is the root or lies below it; a sibling with the same beginning doesn't."""
    root = root.rstrip("/") or "/"
    return (path == root) | path.startswith(root if root == "/" else root + "/")


def in_scope(files: DataFrame, roots: DataFrame, curated: DataFrame) -> DataFrame:
    """Distinct ids of live files under any root, and the curated ids. files: path, id, scan_status; roots: root; curated: id.

    Every ancestor of a path is looked up in the roots by an equi-join, so no path is compared with every root.
    """
    live = files.where(~F.col("scan_status").eqNullSafe("DELETED") & F.col("path").isNotNull())
    steps = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    up = live.select("id", F.explode(steps).alias("root")).select("id", F.when(F.col("root") == "", "/").otherwise(F.col("root")).alias("root"))
    named = roots.select(F.when(F.rtrim("root", F.lit("/")) == "", "/").otherwise(F.rtrim("root", F.lit("/"))).alias("root")).distinct()
    return up.join(broadcast_if_small(named, named.count(), 200), "root", "left_semi").select("id").union(curated.select("id")).distinct()


def purge_plan(files: DataFrame, root: str) -> DataFrame:
    """Ids with a path under the root, and whether all their paths are (their derived rows go) or others share them."""
    flagged = files.select("id", under(F.col("path"), root).alias("under"))
    return flagged.groupBy("id").agg(F.count_if("under").alias("paths_under"), F.count_if(~F.col("under")).alias("paths_elsewhere")).where("paths_under > 0").withColumn("exclusive", F.col("paths_elsewhere") == 0)


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in the given total order, each row with the number of all rows."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def running_totals(series: DataFrame, last: int) -> DataFrame:
    """series: kind, period, added. Running totals over the whole history, then each kind's last periods. Periods without rows stay absent."""
    w = Window.partitionBy("kind").orderBy("period")
    out = series.withColumn("total", F.sum("added").over(w)).withColumn("back", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("period"))))
    return out.where(F.col("back") <= last).drop("back")
