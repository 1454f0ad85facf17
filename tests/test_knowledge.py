"""Structural edges, answers, governance and merges on small fixtures."""

import json
import random

from conftest import rows
from pyspark.sql import functions as F

from lodestack.functions import names
from lodestack.operators import evaluation
from lodestack.operators import governance as V
from lodestack.operators import knowledge as K
from lodestack.operators import responses as P
from lodestack.operators import semantic as M
from lodestack.sources import connectors

REQ = "standard_name string, clause_ref string, title string, text string, quote string, confidence double, seq int"


def surface(spark, known):
    return spark.createDataFrame([(n, o) for n, o in known], "name string, object_id string").select(names.normalize_name(F.col("name")).alias("norm"), "object_id")


KNOWN = [("GDPR", "std_gdpr"), ("EN 1990", "std_en"), ("GDPR Art. 32", "r32"), ("GDPR 30", "r30"), ("EN 1990 V_Rd", "eq")]


def test_mandated_and_specified(spark):
    r = spark.createDataFrame([("GDPR", "Art. 32", None, "", "q1", 0.9, 1), (" GDPR ", "Art. 32", None, "", "q2", None, 2), ("", "Art. 32", None, "", "q3", 0.9, 3), (None, "x", None, "", "", 0.9, 4), ("GDPR", "Art. 99", None, "", "", 0.9, 5)], REQ)
    assert rows(K.gathered(K.mandated_by(r, surface(spark, KNOWN)))) == [("r32", "mandated_by", "std_gdpr", 0.9, 2, "q1 | q2")]
    e = spark.createDataFrame([("EN 1990", "V_Rd", "6", 0.5, "q", 1)], "standard_name string, symbol string, clause_ref string, confidence double, quote string, seq int")
    known = surface(spark, [*KNOWN, ("EN 1990 6", "r6")])
    assert rows(K.of_equations(e, known).select("source", "predicate", "target")) == [("eq", "mandated_by", "std_en"), ("r6", "specifies", "eq")]
    assert rows(K.mandated_by(r.limit(0), surface(spark, KNOWN))) == []


def test_references_need_equal_names(spark):
    r = spark.createDataFrame([("GDPR", "Art. 32", None, "see clause 30 and EN 1990; clause 31", "", 0.8, 1), ("GDPR", "30", None, "in accordance with clause 30", "", 0.8, 2), ("GDPR", None, None, None, "", 0.8, 3)], REQ)
    std = spark.createDataFrame([("GDPR", "std_gdpr"), ("EN 1990", "std_en"), ("EN 19", "std_short"), (None, "none")], "name string, object_id string")
    assert rows(K.references(r, surface(spark, KNOWN), std).select("source", "predicate", "target")) == [("r32", "references", "r30"), ("std_gdpr", "references", "std_en")]


def test_containment_only_where_nothing_ties(spark):
    m = spark.createDataFrame(
        [("s", "Standard", "d1", 0.9, "x", 1), ("r", "Requirement", "d1", 0.4, "low", 2), ("r", "Requirement", "d1", 0.7, "high", 3), ("c", "Concept", "d1", 0.5, None, 4), ("c", "Concept", "d2", 0.9, "elsewhere", 5), ("n", "Concept", None, 0.9, "", 6)],
        "object_id string, object_type string, artifact_id string, confidence double, quote string, seq int",
    )
    edge = "source string, predicate string, target string, confidence double, quote string, seq int"
    none = spark.createDataFrame([], edge)
    assert rows(K.appears_in(m)) == [("c", "appears_in", "s", 0.5, None, 4), ("r", "appears_in", "s", 0.7, "high", 3)]
    mandated = spark.createDataFrame([("s", "mandated_by", "r", 0.3, "m", 9)], edge)
    assert rows(K.consolidated(none, [mandated], none, K.appears_in(m)).select("source", "predicate", "target")) == [("c", "appears_in", "s"), ("s", "mandated_by", "r")]
    crossing = spark.createDataFrame([("c", "references", "s", 0.3, "m", 9), ("r", "references", "s", 0.3, "m", 9)], edge)
    assert rows(K.consolidated(none, [mandated], crossing, K.appears_in(m)).select("source", "predicate")) == [("c", "references"), ("s", "mandated_by")]
    assert rows(K.consolidated(none, [], none, none)) == []


def test_edges_keep_quotes_and_reviews(spark):
    e = spark.createDataFrame([("a", "p", "b", None, f"q{k % 5}", k) for k in range(40)] + [("a", "p", "b", 0.4, " ", 0), ("a", "p", "c", None, None, 1)], "source string, predicate string, target string, confidence double, quote string, seq int")
    g = K.gathered(e)
    assert rows(g) == [("a", "p", "b", 0.4, 41, "q0 | q1 | q2"), ("a", "p", "c", 0.0, 1, "")]
    before = spark.createDataFrame([("a", "p", "b", "APPROVED"), ("a", "p", "c", "PENDING_REVIEW"), ("x", "p", "y", "REJECTED")], "source string, predicate string, target string, review_status string")
    assert rows(K.with_kept_reviews(g, before).select("target", "review_status")) == [("b", "APPROVED"), ("c", "PENDING_REVIEW")]


def test_answers_in_any_wrapping(spark):
    body = json.dumps({"document_type": "REPORT", "type_confidence": 7, "entities": [{"name": "A", "entity_type": "team", "confidence": "x"}, {"name": ""}, "B"], "domains": ["d", {"name": "e", "confidence": 0.2}], "risks": "none", "relationships": [{"subject": "a", "predicate": "Supports", "object": "b"}, {"subject": "a", "object": "b"}]})
    given = [("a", body), ("b", f"Well:\n```json\n{body}\n```"), ("c", f"so {body} it is"), ("d", "{broken"), ("e", None), ("f", ""), ("g", "[1, 2]")]
    p = P.parsed_answers(spark.createDataFrame(given, "artifact_id string, answer string"))
    assert rows(p.select("artifact_id", "ok")) == [(k, k in "abc") for k in "abcdefg"]
    assert rows(p.select("document_type", "type_confidence").distinct()) == [("Other", 0.5), ("Report", 1.0)]
    for k in "abc":
        one = p.where(F.col("artifact_id") == k)
        assert rows(P.rows_of(one, "entities").select("entity_type", "name", "confidence")) == [("Team", "A", 0.5)]
        assert rows(P.rows_of(one, "domains").select("domain", "confidence")) == [("d", 0.5), ("e", 0.2)]
        assert rows(P.rows_of(one, "relationships").select("predicate", "confidence")) == [("supports", 0.5)]
    assert all(P.rows_of(p, n).where("artifact_id IN ('d', 'e', 'f', 'g')").count() == 0 for n in P.SHAPES)
    assert P.rows_of(p, "risks").count() == 0


def test_quality_golden(spark):
    s = "object_id string, evidence_count int, review_state string, freshness_score double, relationship_total int, relationship_rejected int, has_owner boolean, confidence double"
    q = {r.object_id: r.quality_score for r in V.quality(spark.createDataFrame([("strong", 8, "APPROVED", 1.0, 4, 0, True, 0.95), ("weak", 0, "REJECTED", 0.0, 4, 4, False, 0.1), ("none", None, None, None, None, None, None, None)], s)).collect()}
    assert q["strong"] >= 90 and q["weak"] <= 25 and q["none"] == 38.0


def test_payloads_and_orphans(spark):
    d = spark.createDataFrame([(x,) for x in ("", "[]", " {} ", "null", None, "[1]", "text")], "evidence string")
    assert [r.h for r in d.select(V.has_payload(F.col("evidence")).alias("h")).collect()] == [False, False, False, False, False, True, True]
    o = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([(1, "a"), (2, "gone"), (3, None)], "id int, object_id string")
    edges = spark.createDataFrame([("e1", "a", "b", "REJECTED", "[1]"), ("e2", "a", "a", "APPROVED", "[]")], "id string, source string, target string, review_status string, evidence string")
    owners = spark.createDataFrame([("b",)], "object_id string")
    assert rows(V.orphans(o, e, edges, owners)) == [("evidence_without_object", "2"), ("evidence_without_object", "3"), ("objects_without_evidence", "b"), ("objects_without_owner", "a"), ("objects_without_relationships", "b"), ("relationships_without_evidence", "e2")]


def test_fuzzy_merge_against_brute_force(spark):
    rng = random.Random(2)
    words = ["risk", "data", "release", "governance", "board", "plan", "model"]
    given = [(f"a{i}", p, " ".join(rng.sample(words, rng.randrange(1, 4))) + rng.choice(["", "!", " "]), rng.randrange(10) / 10) for i in range(25) for p in range(rng.randrange(1, 6))]
    df = spark.createDataFrame([*given, ("z", 0, None, 0.5)], "artifact_id string, position int, domain string, confidence double")
    text = sorted({g[2] for g in given})
    pairs = spark.createDataFrame([(a, b) for a in text for b in text], "a string, b string")
    n = lambda c: names.normalize_name(F.col(c))
    like = {(r.a, r.b): r.s for r in pairs.select("a", "b", F.round(names.similarity(n("a"), n("b"), names.key_tokens(n("a")), names.key_tokens(n("b")), names.trigrams(n("a")), names.trigrams(n("b"))), 9).alias("s")).collect()}
    want = []
    for item in sorted({g[0] for g in given}):
        kept = []
        for _, _, domain, confidence in sorted(g for g in given if g[0] == item):
            same = next((k for k in kept if like[k[0], domain] >= 0.88), None)
            if same:
                same[1] = max(same[1], confidence)
            else:
                kept.append([domain, confidence])
        want += [(item, d, c, i) for i, (d, c) in enumerate(kept)]
    assert rows(M.fuzzily_merged(df)) == sorted(want)


def test_names_are_measured_by_normal_forms(spark):
    p, g = spark.createDataFrame([("A b!",), ("x",), (None,), ("?",)], "n string"), spark.createDataFrame([("a B",), ("y",)], "n string")
    assert tuple(evaluation.normalized_prf1(p, g, "n").first()) == (1, 0.5, 0.5, 0.5)
    assert evaluation.normalized_prf1(p.limit(0), g.limit(0), "n").first().f1 == 1.0


def test_map_after_a_sync(spark):
    listing = spark.createDataFrame([("a", "2", None), ("b", "1", None), ("n", "1", None), ("f", "9", None)], "remote_id string, version string, modified_at string")
    known = spark.createDataFrame([("a", "1"), ("b", "1"), ("gone", "1"), ("f", "8")], "remote_id string, version string")
    failed = spark.createDataFrame([("f",), ("n",)], "remote_id string")
    assert rows(connectors.synced_map(connectors.sync_plan(listing, known), listing, known, failed)) == [("a", "2"), ("b", "1"), ("f", "8")]
