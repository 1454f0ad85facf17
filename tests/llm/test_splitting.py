from functools import cache

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import splitting as S

PROFILE = "config_id int, provider string, max_input_chars int, chunk_overlap int, piece int"


@settings(max_examples=120, deadline=None)
@given(st.text("ab .,\n", min_size=1, max_size=300), st.integers(1, 60), st.integers(-3, 80))
def test_pieces_cover_overlap_and_fit(text, limit, overlap):
    if len(text) <= limit:
        return
    ends, o = S.cut_points(text, limit, overlap), min(max(overlap, 0), limit - 1)
    start, whole = 0, ""
    for k, end in enumerate(ends):
        assert 0 < end - start <= limit
        whole += text[start:end] if k == 0 else text[start + o : end]
        start = end - o
        assert start >= 0
    assert whole == text


def test_cuts_at_boundaries():
    text = "First sentence here. Second sentence is there.\n\nNew paragraph begins now. And it ends."
    assert [text[:e][-2:] for e in S.cut_points(text, 60, 0)] == ["\n\n", "s."]
    assert S.cut_points("x" * 25, 10, 0)[-1] == 25


def best(text, limit, overlap):
    """The least sum over all ways to cut, by trying them."""
    at, penalty = S._candidates(text, max(1, (limit - overlap) // 16))
    pieces = max(2, -(-(len(text) - overlap) // (limit - overlap)))
    mean = (len(text) - overlap) / pieces + overlap
    cost = dict(zip(at.tolist(), penalty.tolist(), strict=True))

    @cache
    def go(p, first):
        if p == len(text):
            return 0.0
        out = float("inf")
        for q in cost:
            size = q if first else q - p + overlap
            if q > p and size <= limit and q > overlap:
                out = min(out, cost[q] + S.IMBALANCE * ((size - mean) / limit) ** 2 + go(q, False))
        return out

    return go(0, True)


def test_sum_is_least():
    for text, limit, overlap in (("a b. c d, e f. g\nh i j. k l m n. o", 14, 0), ("a b. c d, e f. g\nh i j. k", 12, 4)):
        at, penalty = S._candidates(text, max(1, (limit - overlap) // 16))
        cost, ends = dict(zip(at.tolist(), penalty.tolist(), strict=True)), S.cut_points(text, limit, overlap)
        pieces = max(2, -(-(len(text) - overlap) // (limit - overlap)))
        mean, total, start = (len(text) - overlap) / pieces + overlap, 0.0, 0
        for e in ends:
            total, start = total + cost[e] + S.IMBALANCE * ((e - start - mean) / limit) ** 2, e - overlap
        assert abs(total - best(text, limit, overlap)) < 1e-9


def test_profiles_and_awkward_rows(spark):
    items = spark.createDataFrame([("a", "é" * 20, 1), ("a", "é" * 20, 1), ("b", None, 2), ("c", "", 3), (None, "y" * 30, 4), ("d", "z " * 20_000, 5)], "artifact_dir string, text string, config_id int")
    profiles = spark.createDataFrame([(1, "p", 19, 5, 0), (2, "p", 0, 5, 0), (3, "p", None, None, 0), (4, "p", -1, 0, 0), (5, "p", 25, 99, 0)], PROFILE)
    pieces = S.split(items, profiles)
    assert rows(S.cut_items(pieces).fillna("-")) == [("-", 1), ("-", 5), ("a", 1), ("d", 1), ("d", 3), ("d", 5)]
    assert pieces.where("artifact_dir = 'a'").count() == 2
    assert rows(S.split(items.limit(0), profiles)) == rows(S.split(items, profiles.limit(0))) == []
