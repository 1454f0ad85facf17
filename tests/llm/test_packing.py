import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import packing as P

JOB = "job_id int, capacity_tokens long, doc_id long"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_bins_hold_their_items(sizes):
    lengths = [12, 25, 50, 75, 100]
    where, start, length = P.best_fit(np.array(sizes, np.int64), lengths)
    spans = {}
    for s, b, a in zip(sizes, where.tolist(), start.tolist(), strict=True):
        spans.setdefault(b, []).append((a, a + s))
    for b, xs in spans.items():
        xs.sort()
        assert all(p[1] <= q[0] for p, q in zip(xs, xs[1:], strict=False)) or any(p[0] == p[1] for p in xs)
        filled = sum(y - x for x, y in xs)
        assert length[b] == min(x for x in lengths if x >= filled)


def test_little_is_unused():
    sizes = np.random.default_rng(1).integers(1, 400, 3000)
    _, _, length = P.best_fit(sizes, [128, 256, 512, 768, 1024])
    assert sum(length) <= 1.01 * sizes.sum()


def test_pieces_and_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "é" * 60), (2, ""), (3, None), (None, "x" * 10), (5, "y" * 100), (5, "y" * 100), (7, "z" * 1_000_000)], "doc_id long, text string").withColumnRenamed("unused", "block")
    jobs = spark.createDataFrame([(1, 100, 9), (1, 100, 9), (2, None, 9), (3, 0, 9), (None, 50, 9)], JOB)
    packed = P.pack(docs, jobs)
    assert rows(P.split_documents(packed)) == [(1, 1), (1, 7)]
    assert packed.agg({"piece_tokens": "sum"}).first()[0] == 120 + 10 + 200 + 1_000_000
    assert rows(packed.where("doc_id = 1").select("piece", "piece_start", "piece_tokens")) == [(0, 0, 100), (1, 100, 20)]
    assert packed.where("doc_id = 2").count() == 1
    assert packed.groupBy("bin_id").agg({"piece_tokens": "sum", "bin_tokens": "max"}).where("`sum(piece_tokens)` > `max(bin_tokens)`").count() == 0
    assert rows(P.pack(docs.limit(0), jobs)) == rows(P.pack(docs, jobs.limit(0))) == []


def test_blocks_change_no_total(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('a', cast(id % 90 AS int)) AS text")
    jobs = spark.createDataFrame([(1, 100, 0)], JOB)
    assert P.pack(docs, jobs, block_rows=50).count() == P.pack(docs, jobs).count() == 500
