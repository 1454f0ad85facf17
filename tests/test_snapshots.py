"""Snapshot differences: the tables themselves, random sets against set arithmetic, and the awkward cases."""

import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.operators import links as L
from lodestack.operators import snapshots as S

LINK = "run_id long, id long, source_artifact_id string, raw_url string, normalized_url string, anchor_text string, target_system string, target_type string, link_kind string, last_seen_at timestamp, status string, kh string, row string, root string"
RUN = "id long, scan_root string, started_at timestamp, completed_at timestamp, links_removed long, root string, seq long"


def stamp(day):
    import datetime

    return None if day is None else datetime.datetime(2025, 1, day)


def link(run, art, url, anchor=None, status="ACTIVE", seen=1, system="jira"):
    return (run, 1, art, url, url, anchor, system, "t", "k", stamp(seen), status, "x", "y", "z")


def run(i, root="r", start=1, done=True, removed=0):
    return (i, root, stamp(start), stamp(start) if done else None, removed, "clash", 5)


def changes(spark, links, runs):
    return rows(L.link_changes(spark.createDataFrame(links, LINK), spark.createDataFrame(runs, RUN)))


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 5)), max_size=80), st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 5)), max_size=80), st.integers(0, 60))
def test_difference_is_set_difference(a, b, cells):
    common = set(list(a)[:20])
    a, b = a | common, b | common
    side = lambda s: (np.array([x for x, _ in sorted(s)], np.uint64), np.array([y for _, y in sorted(s)], np.uint64))
    key, value, sign = S.set_difference(side(a), side(b), cells)
    got = {(int(k), int(v), int(s)) for k, v, s in zip(key, value, sign, strict=True)}
    assert got == {(*x, 1) for x in a - b} | {(*x, -1) for x in b - a}


def test_too_small_tables_grow():
    n = np.arange(5000, dtype=np.uint64)
    key, _, sign = S.set_difference((n, n), (n[:0], n[:0]), 0)
    assert len(key) == 5000
    assert (sign == 1).all()


def test_added_removed_changed(spark):
    links = [link(1, "a", "u1"), link(1, "a", "u2"), link(1, "b", "u3"), link(2, "a", "u1", seen=9), link(2, "b", "u3", status="STALE"), link(2, "b", "u4")]
    assert changes(spark, links, [run(1), run(2, start=2)]) == [(2, "a", "u2", "", "removed"), (2, "b", "u3", "", "changed"), (2, "b", "u4", "", "added")]


def test_broken_runs_first_runs_and_other_roots(spark):
    links = [link(1, "a", "u"), link(2, "a", "v"), link(3, "a", "u"), link(4, "a", "w"), link(99, "a", "q")]
    runs = [run(1), run(2, start=2, done=False), run(3, start=3), run(3, start=3), run(4, root="other")]
    assert changes(spark, links, runs) == []


def test_empty_run_between(spark):
    links = [link(1, "a", "u"), link(3, "a", "u")]
    assert changes(spark, links, [run(1), run(2, start=2), run(3, start=3)]) == [(2, "a", "u", "", "removed"), (3, "a", "u", "", "added")]


def test_keys_in_one_spelling(spark):
    links = [link(1, " a", "HTTPS://Host.X/Path \n", None), link(2, "a", "https://host.x/Path", " "), link(1, "a", "FTP://H/p"), link(2, "a", "ftp://H/p")]
    assert changes(spark, links, [run(1), run(2, start=2)]) == [(2, "a", "FTP://H/p", "", "removed"), (2, "a", "ftp://H/p", "", "added")]


def test_latest_row_counts_and_null_is_oldest(spark):
    links = [link(1, "a", "u", status="OLD", seen=None), link(1, "a", "u", status="NEW", seen=2), link(2, "a", "u", status="NEW", seen=3), link(2, "a", "u", status="LATE", seen=1), link(2, "a", "u", status="NEW", seen=3)]
    assert changes(spark, links, [run(1), run(2, start=2)]) == []


def test_nulls_everywhere(spark):
    links = [(1, *[None] * 13), (2, *[None] * 13), (None, *[None] * 13), link(2, None, None, status=None)]
    got = changes(spark, links, [run(1), run(2, start=2), (None, None, None, stamp(1), None, None, None)])
    assert got == [(2, None, None, "", "changed")]


def test_many_buckets_agree_with_one(spark):
    from pyspark.sql import functions as F

    base = spark.range(3000).select(F.col("id").alias("k"))
    data = base.select(F.lit(1).cast("long").alias("run_id"), "k", F.lit("a").alias("v")).union(base.where("k % 7 <> 0").select(F.lit(2).cast("long"), F.col("k") + 5, F.when(F.col("k") % 11 == 0, "b").otherwise("a")))
    data = data.withColumn("last_seen_at", F.lit(None).cast("timestamp"))
    runs = spark.createDataFrame([(1, "r", stamp(1), stamp(1)), (2, "r", stamp(2), stamp(2))], "id long, root string, started_at timestamp, completed_at timestamp")
    one = rows(S.snapshot_changes(data, runs, {"k": F.col("k")}, ["v"]))
    many = rows(S.snapshot_changes(data, runs, {"k": F.col("k")}, ["v"], bucket_rows=100))
    old = {r.k: r.v for r in data.where("run_id = 1").collect()}
    new = {r.k: r.v for r in data.where("run_id = 2").collect()}
    want = [(2, k, "added") for k in new.keys() - old.keys()] + [(2, k, "removed") for k in old.keys() - new.keys()] + [(2, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]]
    assert one == many == sorted(want)


def test_empty_tables(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [], [run(1), run(2, start=2)]) == []
    assert rows(L.removal_report(spark.createDataFrame([], "run_id long, change_kind string"), spark.createDataFrame([run(1, removed=3)], RUN)).select("run_id", "removed", "truthful")) == [(1, 0, False)]
