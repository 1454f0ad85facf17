"""Remote systems as data sources: a listing split into pages that executors read.

A system is a listing function (page number -> rows of remote_id, name, version, modified_at) registered under a name. The
network is no part of this package; the 'folder' system lists JSON-lines files, one a page, and stands for any of them in tests.
"""

from __future__ import annotations

import glob
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SYSTEMS: dict[str, tuple[Callable[[dict], int], Callable[[dict, int], Iterator[dict]]]] = {}
SCHEMA = "remote_id string, name string, version string, modified_at string, content binary"


def register(name: str, pages: Callable[[dict], int], rows: Callable[[dict, int], Iterator[dict]]) -> None:
    SYSTEMS[name] = (pages, rows)


def _files(options: dict) -> list[str]:
    return sorted(glob.glob(f"{options['path']}/*.jsonl"))


def _rows(options: dict, page: int) -> Iterator[dict]:
    with open(_files(options)[page], encoding="utf-8") as f:
        for line in f:
            if line.strip():
                yield json.loads(line)


register("folder", lambda o: len(_files(o)), _rows)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.system = dict(options), SYSTEMS[options.get("system", "folder")]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.system[0](self.options))] or [InputPartition(-1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value >= 0:
            for r in self.system[1](self.options, partition.value):
                content = r.get("content")
                yield r.get("remote_id"), r.get("name"), r.get("version"), r.get("modified_at"), content.encode() if isinstance(content, str) else content


class Listing(DataSource):
    """spark.dataSource.register(Listing); spark.read.format('listing').option('system', …).load()"""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return ListingReader(self.options)


def local_path(cache: str, connector: str, remote_id: Column, name: Column) -> Column:
    """Where a remote document is kept: a folder by the hash of its id, so that names don't clash."""
    return F.concat_ws("/", F.lit(cache), F.lit(connector), F.substring(F.sha1(remote_id), 1, 16), name)


def synced_map(plan: DataFrame, listing: DataFrame, known: DataFrame, failed: DataFrame) -> DataFrame:
    """remote_id and version on the map after a plan was carried out: fetched ones as listed, kept ones and those whose fetch failed (remote_id) as known, dropped ones gone."""
    now = listing.where(F.col("remote_id").isNotNull()).groupBy("remote_id").agg(F.max_by("version", F.coalesce("modified_at", F.lit(""))).alias("now"))
    was = known.groupBy("remote_id").agg(F.max("version").alias("was"))
    p = plan.where("action <> 'drop'").join(failed.select("remote_id", F.lit(True).alias("failed")).distinct(), "remote_id", "left").join(now, "remote_id", "left").join(was, "remote_id", "left")
    old = F.coalesce(F.col("failed"), F.lit(False)) | (F.col("action") == "keep")
    return p.select("remote_id", F.when(old, F.col("was")).otherwise(F.col("now")).alias("version")).where("version IS NOT NULL")


def sync_plan(listing: DataFrame, known: DataFrame) -> DataFrame:
    """remote_id, action: fetch (new or another version), keep, or drop (gone). known: remote_id, version. A full outer join on the id; repeated listings take the last by modified_at."""
    new = listing.groupBy("remote_id").agg(F.max_by("version", F.coalesce("modified_at", F.lit(""))).alias("now"), F.lit(True).alias("here"))
    old = known.select("remote_id", F.col("version").alias("was"), F.lit(True).alias("there")).distinct()
    j = new.join(old, "remote_id", "full")
    return j.select("remote_id", F.when(F.col("here").isNull(), "drop").when(F.col("there") & F.col("now").eqNullSafe(F.col("was")), "keep").otherwise("fetch").alias("action"))
