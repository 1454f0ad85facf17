import pytest
from conftest import rows

from lodestack.llm import mixing as M

TARGET = "mix_id int, source string, target_share double, max_repeats int, budget_ratio double, src string"


def docs(spark, n=4000):
    return spark.range(n).selectExpr("id AS doc_id", "repeat('x', cast(20 + id % 50 AS int)) AS text", "CASE WHEN id % 10 < 6 THEN ' Big ' WHEN id % 10 < 9 THEN 'mid' ELSE 'small' END AS source", "'clash' AS tokens", "1 AS block")


def test_shares_and_repeats(spark):
    t = spark.createDataFrame([(1, "big", 0.5, 1, 0.5, ""), (1, "mid", 0.3, 1, 0.5, ""), (1, "small", 0.2, 2, 0.5, ""), (2, "small", 1.0, 3, 1.0, "")], TARGET)
    records, report = M.mix(docs(spark), t, block_tokens=1000)
    r = {(x.mix_id, x.source): x for x in report.collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert r[1, s].feasible and abs(r[1, s].actual_share - share) < 0.002
    assert not r[2, "small"].feasible and r[2, "small"].taken_tokens == r[2, "small"].available_tokens
    assert rows(M.unmet(report)) == [(2, "small")] == rows(report.where("NOT feasible").select("mix_id", "source"))
    assert records.groupBy("mix_id", "doc_id").count().agg({"count": "max"}).first()[0] == 3
    assert records.select("mix_id", "source", "doc_id", "repeat").distinct().count() == records.count()


def test_schedule_is_even(spark):
    t = spark.createDataFrame([(1, "big", 0.5, 1, 0.5, ""), (1, "mid", 0.5, 3, 0.5, "")], TARGET)
    records, _ = M.mix(docs(spark), t, block_tokens=500)
    got = records.orderBy("slot", "slot_offset").toPandas()
    share = (got.tokens * (got.source == "big")).cumsum() / got.tokens.cumsum()
    assert ((share[len(share) // 5 :] - 0.5).abs() < 0.06).all()


def test_awkward_rows(spark):
    d = spark.createDataFrame([(1, "abc", None), (2, None, "a"), (3, "", "a"), (None, "abcd", "A "), (5, "xy", "b")], "doc_id long, text string, source string")
    t = spark.createDataFrame([(1, "a", 0.4, None, 1.0, ""), (1, "a", 0.4, None, 1.0, ""), (1, None, 0.5, 1, 1.0, ""), (1, "gone", 0.1, 1, 1.0, ""), (2, "b", None, 1, None, "")], TARGET)
    records, report = M.mix(d, t)
    assert rows(records.select("mix_id", "source", "tokens")) == [(1, "a", 4)]
    assert sorted(((x.mix_id, str(x.source), x.feasible) for x in report.collect())) == [(1, "None", False), (1, "a", True), (1, "gone", False), (2, "b", True)]
    for dd, tt in ((d.limit(0), t), (d, t.limit(0))):
        assert rows(M.mix(dd, tt)[0]) == []


@pytest.mark.parametrize("bucket", [7, 4096])
def test_offsets_lie_end_to_end(spark, bucket, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
    t = spark.createDataFrame([(1, "mid", 1.0, 1, 1.0, "")], TARGET)
    d = docs(spark, 500)
    laid = sorted((r.offset, r.tokens) for r in M._laid_out(d, M.quotas(d, t)).collect())
    assert laid[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(laid, laid[1:], strict=False))
