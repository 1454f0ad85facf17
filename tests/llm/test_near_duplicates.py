import itertools
import random

import numpy as np
from conftest import rows

from lodestack.llm import near_duplicates as N


def brute(items, words=3, like=0.5):
    sets = {k: {tuple(x[i : i + words]) for i in range(len(x) - words + 1)} for k, t in items if t and len(x := N._WORD.findall(t.lower())) >= words}
    group = {k: k for k in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= like * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(group[a], group[b])
            changed |= group[a] != m or group[b] != m
            group[a] = group[b] = m
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if group[a] == group[b])


def edited(rng, words, n):
    w = words[:]
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + rng.choice([0, 1])] = [rng.choice("abcdefghij")] if rng.random() < 0.7 else []
    return " ".join(w)


def test_groups_are_those_of_brute_force(spark):
    rng = random.Random(7)
    items = []
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(60)]
        items += [(f"d{g:02}_{i}", edited(rng, base, rng.randrange(8))) for i in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(items, "artifact_dir string, text string")
    assert rows(N.group_pairs(N.near_duplicate_groups(df))) == brute(items)


def test_signature_estimates_likeness():
    x = np.random.default_rng(1).integers(0, 2**63, 900, dtype=np.uint64)
    a, b = N.signature(x[:600]), N.signature(x[300:])
    assert abs((a == b).mean() - 1 / 3) < 0.08


def test_one_bucket_of_many(spark):
    """Hundreds of different texts that share nearly all their shingles: one group, and no more comparisons than members."""
    base = " ".join(f"w{i}" for i in range(80))
    df = spark.range(600).selectExpr("cast(id AS string) AS artifact_dir", f"concat('{base} x', id) AS text")
    g = N.near_duplicate_groups(df)
    assert g.count() == 600 and g.select("group_id").distinct().count() == 1


def test_awkward_rows(spark):
    t = "one two three four five"
    df = spark.createDataFrame([("a", t, 1), ("a", t, 1), ("b", t.upper() + "!", 1), ("c", None, 1), ("d", "", 1), ("e", "two words", 1), ("f", "two words", 1), (None, t, 1), ("g", "a b c " * 40_000, 1)], "artifact_dir string, text string, set_id int")
    assert rows(N.near_duplicate_groups(df)) == [("a", "a"), ("b", "a")]
    assert rows(N.near_duplicate_groups(df.limit(0))) == []


def test_item_with_two_texts_ties_them(spark):
    df = spark.createDataFrame([("a", "one two three"), ("b", "four five six"), ("c", "one two three"), ("c", "four five six")], "artifact_dir string, text string")
    assert rows(N.near_duplicate_groups(df)) == [("a", "a"), ("b", "a"), ("c", "a")]
