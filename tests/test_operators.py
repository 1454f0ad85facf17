"""Core operators on small fixtures: golden values, awkward rows, brute force."""

import itertools
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestack.functions import names, times, urls
from lodestack.operators import documents, evaluation, exports, formulas, graph, history, resolution, retrieval, scan, semantic
from lodestack.operators.components import components
from lodestack.operators.links import extract_links, url_key
from lodestack.plans import graph as graph_plans
from lodestack.plans import history as history_plans
from lodestack.sources import connectors, files, standards
from lodestack.streaming import events


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://example.com/page).", "https://example.com/page"),
        ("HTTPS://Example.COM/p#section", "https://example.com/p"),
        ("https://e.com/a?utm_source=x&b=1&flag#!/r", "https://e.com/a?b=1&flag=#!/r"),
        ("mailto:John.Doe@Example.COM?subject=Hi", "mailto:john.doe@example.com"),
        ("/home/user/report.pdf", "file:///home/user/report.pdf"),
        ("C:\\docs\\report.docx", "file:///C:/docs/report.docx"),
        (None, ""),
        ("  ", ""),
    ],
)
def test_normal_urls(spark, raw, want):
    assert one(spark, raw, urls.normalize_url) == want


@pytest.mark.parametrize(
    ("url", "system", "kind"),
    [
        ("https://x.sharepoint.com/sites/a/b.docx", "sharepoint", "document"),
        ("https://a-my.sharepoint.com/personal/z/Documents", "onedrive", "folder"),
        ("https://dev.azure.com/o/p/_workitems/edit/4", "azure_devops", "work_item"),
        ("https://jira.x.com/browse/A-1", "jira", "work_item"),
        ("https://x.atlassian.net/wiki/spaces/A", "confluence", "wiki_page"),
        ("https://github.com/o/r/pull/3", "github", "pull_request"),
        ("https://teams.microsoft.com/l/channel/1", "teams", "channel"),
        ("mailto:a@b.c", "email", "email_address"),
        ("file:///a/b.pdf", "local_file", "document"),
        ("https://e.org/x", "external_web", "unknown"),
        ("nothing", "unknown", "unknown"),
    ],
)
def test_link_classes(spark, url, system, kind):
    assert one(spark, url, urls.target_system) == system
    assert one(spark, url, lambda c: urls.target_type(c, F.lit(system))) == kind


def test_url_key(spark):
    assert one(spark, "\t HTTP://A.b?Q=R/S \n", url_key) == "http://a.b?Q=R/S"
    assert one(spark, "https://A.B/C/D", url_key) == "https://a.b/C/D"
    assert one(spark, None, url_key) is None


def test_names(spark):
    assert one(spark, "  Weird/Name!! ", names.slugify) == "weird_name"
    assert one(spark, "???", names.slugify) == "unnamed"
    assert one(spark, None, names.normalize_name) == ""
    assert one(spark, "Release governance!", names.normalize_name) == "release governance"


def test_similarity_bands(spark):
    pairs = [("Release Governance", "RELEASE governance!"), ("Customer Data", "Customer Data Platform"), ("Data", "Data Platform"), ("Release Management", "Release Governance"), ("Release Governance", "Salesforce Platform"), ("", "x")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    na, nb = names.normalize_name(F.col("a")), names.normalize_name(F.col("b"))
    s = [r.s for r in df.select("i", names.similarity(na, nb, names.key_tokens(na), names.key_tokens(nb), names.trigrams(na), names.trigrams(nb)).alias("s")).orderBy("i").collect()]
    assert s[0] == 1.0 and s[1] >= 0.88 and s[2] < 1 and s[3] < 0.72 and s[4] < 0.3 and s[5] == 0.0


def test_times(spark):
    assert one(spark, "t", times.moment) is None
    assert one(spark, "2024-02-30T00:00:00Z", times.moment) is None
    assert one(spark, "2024-01-02T03:04:05.678901+00:00", times.moment).microsecond == 678901
    assert one(spark, 0.0, times.freshness, "double") == 1.0
    assert one(spark, 730.0, times.freshness, "double") == 0.0


def brute(edges):
    group = {}
    for a, b in edges:
        group.setdefault(a, a), group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(group[a], group[b])
            changed |= group[a] != m or group[b] != m
            group[a] = group[b] = m
    return sorted(group.items())


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(random.Random(s).randrange(60), random.Random(s + 999).randrange(60)) for s in range(45)], [(3, 3), (5, 4), (4, 5)]])
def test_components(spark, edges):
    assert rows(components(spark.createDataFrame(edges, "a long, b long"))) == brute(edges)


def test_components_of_nothing(spark):
    assert rows(components(spark.createDataFrame([(None, 1)], "a long, b long"))) == []


def test_scan_diff_and_duplicates(spark):
    now = spark.createDataFrame([("a", "1", "s"), ("b", "2", "s"), ("c", "1", "s"), ("n", None, "s")], "path string, sha256 string, seen_at string")
    was = spark.createDataFrame([("a", "1", "t"), ("b", "9", "t"), ("d", "1", "t"), ("n", None, "t")], "path string, sha256 string, first_seen_at string")
    found = scan.diff(now, was)
    assert rows(found.select("path", "status", "first_seen_at")) == [("a", "UNCHANGED", "t"), ("b", "CHANGED", "t"), ("c", "RAW", "s"), ("d", "DELETED", "t"), ("n", "UNCHANGED", "t")]
    assert rows(scan.flag_duplicates(found).where("is_duplicate").select("path")) == [("c",)]
    empty = now.limit(0)
    assert rows(scan.diff(empty, was.limit(0))) == []


def test_scope_keeps_siblings_out(spark):
    f = spark.createDataFrame([("/v/a/x", "1", "RAW"), ("/v/ab/x", "2", "RAW"), ("/v/a", "3", None), ("/v/a/y", "4", "DELETED"), (None, "5", "RAW")], "path string, id string, scan_status string")
    roots, curated = spark.createDataFrame([("/v/a/",)], "root string"), spark.createDataFrame([("9",)], "id string")
    assert rows(scan.in_scope(f, roots, curated)) == [("1",), ("3",), ("9",)]


def test_upsert_keeps_what_is_kept(spark):
    s = "k string, v string, first string"
    got = scan.upsert(spark.createDataFrame([("a", "1", "old"), (None, "2", "old")], s), spark.createDataFrame([("a", None, "new"), (None, "3", "new"), ("b", "4", "new")], s), ["k"], ["first"])
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("a", None, "old"), (None, "3", "old"), ("b", "4", "new")]))


def test_links_of_texts(spark):
    t = spark.createDataFrame([(1, "[a](https://x.y/z) https://x.y/z and mailto:q@r.s"), (2, ""), (3, None), (4, "[a](rel/link)")], "k int, text string")
    assert rows(extract_links(t, "k").select("k", "raw_url", "anchor_text").fillna("")) == [(1, "https://x.y/z", "a"), (1, "mailto:q@r.s", "")]


def test_blocking_loses_no_pair(spark):
    rng = random.Random(5)
    words = ["red", "blue", "bolt", "gear", "large", "small", "steel", "model", "grade", "café"]
    sample = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)})
    reps = spark.createDataFrame([(w, "k", w) for w in sample], "id string, kind string, name string")
    p = resolution.prepared(reps).select("name", "norm", "tokens", "grams")
    every = p.alias("l").join(p.alias("r"), F.col("l.name") < F.col("r.name")).select(F.col("l.name").alias("a"), F.col("r.name").alias("b"), F.round(names.similarity(*[F.col(f"{x}.{c}") for c in ("norm", "tokens", "grams") for x in "lr"]), 6).alias("s"))
    assert rows(every.where("s >= 0.72")) == rows(resolution.blocked_pairs(reps, 0.72))


def test_clusters_need_confidence(spark):
    m = spark.createDataFrame([("K", "Release Governance", "d1", 0.9), ("K", "release governance!", "d2", 0.9), ("K", "Release Governance Model", "d3", 0.8), ("K", "Other", "d4", 0.1), ("K", None, "d5", 0.9), ("Q", "Release Governance", "d6", None)], "kind string, name string, artifact_id string, confidence double")
    report = resolution.cluster_report(m, resolution.clusters(m))
    assert rows(report.select("canonical_name", "documents", "mentions", "cohesion")) == [("Release Governance", 3, 3, 1.0)]


def test_domains_of_any_json(spark):
    def parsed(x):
        return [tuple(d) for d in one(spark, x, semantic.parsed_domains) or []]

    assert parsed('[{"domain": " Law ", "confidence": 2}, "Sport", {"confidence": 1}, {"domain": "X", "confidence": "high"}, null]') == [("Law", 1.0), ("Sport", 0.5), ("X", 0.5)]
    assert parsed('[{"domain": "La') == parsed("") == parsed(None) == parsed("{}") == []


GRAPH = [("a", "p", "b"), ("b", "p", "c"), ("c", "q", "d"), ("e", "p", "f"), ("a", "q", "b")]


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame(GRAPH, "source string, predicate string, target string")
    v = spark.createDataFrame([(x, "K" if x < "d" else "L", x.upper() * 2, 0.5) for x in "abcdefz"], "id string, kind string, label string, confidence double")
    return v, e


def test_paths(spark, small):
    v, e = small
    assert [r.id for r in graph.shortest_path(e, "d", "a").orderBy("step").collect()] == ["d", "c", "b", "a"]
    assert rows(graph.shortest_path(e, "a", "f")) == []
    assert [r.id for r in graph.shortest_path(e, "a", "a").collect()] == ["a"]
    assert rows(graph.distances(e, spark.createDataFrame([("a",), (None,)], "id string"), 2)) == [("a", 0), ("b", 1), ("c", 2)]
    assert graph.summary(e, v).first().components == 3


def test_betweenness_and_communities(small):
    _, e = small
    assert {r.id: r.betweenness for r in graph.betweenness(e).collect()} == {"a": 0, "b": 2, "c": 2, "d": 0, "e": 0, "f": 0}
    c = {r.id: r.community for r in graph.communities(e).collect()}
    assert c["a"] == c["b"] and c["c"] == c["d"] and c["e"] == c["f"] and len(set(c.values())) == 3


def _brute_betweenness(edges):
    """Pairs of vertices, and the share of their shortest paths that each other vertex lies on."""
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    dist, paths = {}, {}
    for s in adj:
        dist[s, s], paths[s, s], order = 0, 1, [s]
        for v in order:
            for w in adj[v]:
                if (s, w) not in dist:
                    dist[s, w], paths[s, w] = dist[s, v] + 1, 0
                    order.append(w)
                if dist[s, w] == dist[s, v] + 1:
                    paths[s, w] += paths[s, v]
    return {v: sum(paths[s, v] * paths[v, t] / paths[s, t] for s in adj for t in adj if s < t and v not in (s, t) and (s, t) in dist and (s, v) in dist and dist[s, v] + dist[v, t] == dist[s, t]) for v in adj}


def test_betweenness_of_folded_graphs(spark, monkeypatch):
    """Trees, chains, pairs, and cycles with trees on them, against brute force, with the sources in one part and in many."""
    tree = [(f"s{i}", f"n{i % 3}") for i in range(9)] + [(f"n{i}", "r") for i in range(3)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("p", "q"), ("q", "p")]
    cycles = [(f"g{i}", f"g{(i + k) % 8}") for i in range(8) for k in (1, 3) if i != 2] + [(f"g{i % 3}", f"h{i}") for i in range(12)] + [(f"h{i}", f"k{i}") for i in range(0, 12, 3)]
    edges = tree + chain + cycles
    want = _brute_betweenness(edges)
    df = spark.createDataFrame([(a, "p", b) for a, b in edges] + [("z", "p", "z"), (None, "p", "x")], "source string, predicate string, target string")
    for work in (graph.SOURCE_WORK, 50):
        monkeypatch.setattr(graph, "SOURCE_WORK", work)
        assert {r.id: r.betweenness for r in graph.betweenness(df).collect()} == pytest.approx(want)


def test_betweenness_of_a_large_hub(spark):
    """More leaves than a task would take, and a path for each two of them."""
    n = graph.MOST_EDGES + 1
    df = spark.range(n).selectExpr("'leaf/' || id AS source", "'p' AS predicate", "'hub' AS target")
    top = graph.betweenness(df).where("betweenness > 0")
    assert rows(top) == [("hub", n * (n - 1) / 2)]


def _brute_communities(adj):
    """All gains, in whole numbers, are worked out again after every union."""
    m2 = sum(len(x) for x in adj.values())
    group, ties, degree = {v: [v] for v in adj}, {v: dict.fromkeys(x, 1) for v, x in adj.items()}, {v: len(x) for v, x in adj.items()}
    while True:
        gains = [(e * m2 - degree[a] * degree[b], [-ord(c) for c in a + b], a, b) for a, x in ties.items() for b, e in x.items() if a < b]
        gain, _, a, b = max(gains, default=(0, [], "", ""))
        if gain <= 0:
            return {v: g for g, vs in group.items() for v in vs}
        group[a] += group.pop(b)
        degree[a] += degree.pop(b)
        for c, e in ties.pop(b).items():
            del ties[c][b]
            if c != a:
                ties[a][c] = ties[c][a] = ties[a].get(c, 0) + e


def test_communities_against_brute_force():
    """Trees and graphs with many ties of gains and names that begin others."""
    dice = random.Random(3)
    for k in range(2, 120):
        names = sorted({dice.choice("ab/") + "".join(dice.choices("ab1", k=dice.randrange(4))) for _ in range(k % 20 + 4)})
        dice.shuffle(names)
        adj = {v: set() for v in names}
        for i in range(1, len(names)):
            for j in {dice.randrange(min(i, k % 4 + 1)), dice.randrange(i) if k % 3 == 0 else 0}:
                adj[names[i]].add(names[j])
                adj[names[j]].add(names[i])
        adj = {v: sorted(x) for v, x in sorted(adj.items())}
        assert graph._communities(adj) == _brute_communities(adj)


def test_communities_by_component(spark):
    """A cycle with trees on it, a tree and a pair: each as alone."""
    cycle = [(f"g{i}", f"g{(i + 1) % 6}") for i in range(6)] + [(f"g{i % 3}", f"h{i}") for i in range(9)] + [(f"h{i}", f"k{i}") for i in range(0, 9, 3)]
    tree = [(f"s{i}", f"n{i % 3}") for i in range(9)] + [(f"n{i}", "r") for i in range(3)]
    want = {}
    for part in (cycle, tree, [("x", "y")]):
        adj = {}
        for a, b in part:
            adj.setdefault(a, []).append(b)
            adj.setdefault(b, []).append(a)
        want |= _brute_communities(adj)
    df = spark.createDataFrame([(a, "p", b) for a, b in [*cycle, *tree, ("x", "y"), ("y", "x"), ("z", "z"), (None, "x")]], "source string, predicate string, target string")
    assert {r.id: r.community for r in graph.communities(df).collect()} == want


def test_communities_of_large_hubs(spark):
    """Two hubs of as many leaves as are past trying all pairs at each step, and one edge between them."""
    n = 60_000
    df = spark.range(2 * n).selectExpr("'leaf/' || id AS source", "'p' AS predicate", "'hub/' || id % 2 AS target").union(spark.createDataFrame([("hub/0", "p", "hub/1")]))
    assert rows(graph.communities(df).groupBy("community").count()) == [("hub/0", n + 1), ("hub/1", n + 1)]


def test_related_of_kind(spark, monkeypatch):
    """Each pair once, also of two kinds in common, and the same whether a side is broadcast or dealt to shares; only pairs of one kind are made."""
    kinds = {"s1": "KL", "s2": "LK", "s3": "K", "d1": "K", "d2": "M", "s4": "N"}
    ties = [("s1", "supports", "v"), ("s1", "depends_on", "v"), ("s2", "supports", "v"), ("s3", "supports", "w"), ("d1", "depends_on", "v"), ("d2", "depends_on", "v"), ("s4", "supports", "v"), ("s3", "related_to", "v")]
    t = spark.createDataFrame([(s, "type", k) for s, x in kinds.items() for k in x] + ties, "s string, p string, o string")
    want = [("d1", "s1", "v"), ("d1", "s2", "v"), ("s1", "s2", "v"), ("s2", "s1", "v")]
    for most in (graph.BROADCAST_BYTES, 0):
        monkeypatch.setattr(graph, "BROADCAST_BYTES", most)
        assert rows(graph.related_of_kind(t)) == want


def test_related_of_kind_leaves_other_kinds_out(spark):
    """A hub that 200,000 of one kind depend on and 2,000 of another support: the 400 million pairs of unlike kinds are not made."""
    n, m = 200_000, 2_000
    ids = spark.range(n).selectExpr("'c/' || id AS s", "'C' AS kind", "'depends_on' AS p").union(spark.range(m).selectExpr("'s/' || id", "'S'", "'supports'"))
    t = ids.selectExpr("s", "'type' AS p", "kind AS o").union(ids.selectExpr("s", "p", "'v' AS o"))
    assert graph.related_of_kind(t).count() == m * (m - 1)


def test_patterns(small):
    t = graph.triples(*small)
    assert rows(graph.Pattern(t).match("?x", "p", "?y").absent("?y", "p", "?z").rows.select("x", "y")) == [("b", "c"), ("e", "f")]
    with pytest.raises(ValueError, match="cross join"):
        graph.Pattern(t).match("?x", "p", "?y").match("?z", "q", "?w")


def test_drift(spark):
    s = "object_id string, object_type string, document_count int"
    p, c = spark.createDataFrame([("a", "T", 6), ("b", "T", 2), ("c", "T", 8), ("z", "T", 0)], s), spark.createDataFrame([("n", "T", 1), ("c", "T", 4), ("z", "T", 0)], s)
    assert rows(history.drift(p, c)) == [("disappearing_evidence", "c", ""), ("removed", "a", ""), ("terminology_change", "a", "n")]


def _line_items(spark, folder, items):
    """Tables of line items (part, order, quantity, shipped) and two parts."""
    spark.createDataFrame([(p, o, float(q), "N", 0.0, t) for p, o, q, t in items], "l_partkey long, l_orderkey long, l_quantity double, l_returnflag string, l_discount double, l_shipdate string").withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "bolt", "A", "T"), (2, "nut", "A", "T")], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_drift_of_whole_tables(spark, tmp_path):
    d = _line_items(spark, tmp_path, [(1, o, 3, "1999-05-05") for o in range(5)] + [(2, 9, 3, "2000-05-05")])
    q = history_plans.QUERIES
    assert rows(q["gov_drift"].run(spark, d)) == [("removed", "bolt/A", ""), ("terminology_change", "bolt/A", "nut/A")]


def test_components_of_whole_tables(spark, tmp_path):
    d = _line_items(spark, tmp_path, [(1, 1, 3, "1999-05-05"), (1, 2, 3, "1999-05-05"), (2, 3, 3, "1999-05-05")])
    q = graph_plans.QUERIES
    assert rows(q["graph_components"].run(spark, d)) == [("order/1", "order/1"), ("order/2", "order/1"), ("order/3", "order/3"), ("part/1", "order/1"), ("part/2", "order/3")]
    assert tuple(q["graph_summary"].run(spark, d).first()) == (5, 3, 0.15, 2)


def test_changed_triples(spark):
    s = "source string, predicate string, target string"
    known = spark.createDataFrame([("a", "p", "b"), ("c", "p", "d"), ("e", "p", "f")], s)
    current = spark.createDataFrame([("a", "p", "b"), ("a", "p", "b"), ("c", "q", "d"), ("g", "p", "h"), ("g", "p", "h")], s)
    assert rows(history.changed_triples(known, current)) == [("c", "p", "d", "removed"), ("c", "q", "d", "added"), ("e", "p", "f", "removed"), ("g", "p", "h", "added")]


def test_terms(spark, small):
    v, _ = small
    got = retrieval.resolve_terms(spark.createDataFrame([("a",), ("BB",), ("c",), ("nope",)], "term string"), v)
    assert rows(got.fillna("-")) == [("BB", "b"), ("a", "a"), ("c", "c"), ("nope", "-")]


def test_clauses_and_formulas():
    assert documents.clauses("Design in accordance with clause 6.2 and 6.3; see 7.3.1.") == ["6.2", "6.3", "7.3.1"]
    assert documents.clauses("1.5 and 2.0") == documents.clauses(None) == []
    good = formulas.analyse("sqrt(a*x) + pi * b", "V_Rd,c")
    assert good.valid and good.variables == ("a", "b", "x") and good.function_code == "def V_Rd_c(a, b, x):\n    return sqrt(a*x) + pi * b"
    assert json.loads(good.ast_json)["right"] == {"op": "Mult", "left": {"var": "pi"}, "right": {"var": "b"}}
    for bad in ("__import__('os')", "a.b", "open('x')", "lambda: 1", "", None, "a +", "max(a, key=b)", "a @ b", "a in b", "a is b", "~a", "a << b", "[a]", "(" * 400 + ")" * 400):
        assert not formulas.analyse(bad).valid and formulas.analyse(bad).note
    for fine in ("sinh(x)", "atan2(y, x)", "log2(n) + hypot(a, b)", "degrees(a) if a > 0 and not b else -a ** 2 % 3 // 1", "a < b <= c != d"):
        assert formulas.analyse(fine).valid
    assert formulas.analyse(None, None, "def f(x):\n    return x + 1").expression == "x + 1"


def test_measures_of_nothing(spark):
    e = spark.createDataFrame([], "k int, text string, part string")
    assert evaluation.prf1(e, e, ["k"]).first().f1 == 1.0
    assert evaluation.accuracy(e, "k", "k").first().accuracy == 1.0
    assert evaluation.contained_share(e).first().share == 1.0


def test_exports(spark, small, tmp_path):
    v, e = small
    v = v.withColumn("label", F.concat("label", F.lit(' "q"\n\\')))
    exports.write_n_triples(graph.triples(v, e), str(tmp_path / "t"), ["label", "confidence"])
    assert tuple(exports.check_n_triples(spark, str(tmp_path / "t")).first()) == (26, 0)
    exports.write_graphml(v, e, str(tmp_path / "g.xml"))
    exports.write_gexf(v, e, str(tmp_path / "g.gexf"))
    from xml.etree import ElementTree

    assert len(list(ElementTree.parse(tmp_path / "g.xml").iter("{http://graphml.graphdrawing.org/xmlns}edge"))) == 5
    assert len(list(ElementTree.parse(tmp_path / "g.gexf").iter("{http://gexf.net/1.3}node"))) == 7


def test_files_and_standards(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for n, t in (("a.md", "x"), ("b.txt", "x"), ("c.bin", "x"), ("skip.md", "y")):
        (tmp_path / "docs" / n).write_text(t)
    found = files.documents(spark, str(tmp_path / "docs"), [".md", "txt"], ["skip*"])
    assert [r.path.rsplit("/", 1)[1] for r in found.orderBy("path").collect()] == ["a.md", "b.txt"]
    assert found.select("id").distinct().count() == 1
    (tmp_path / "s.json").write_text('{"standard": {"name": "S"}, "requirements": [{"clause_ref": "1", "title": "T"}]}')
    (tmp_path / "s.csv").write_text("standard_name,clause_ref\nS,2\n")
    a, b = standards.load(spark, str(tmp_path / "s.json")), standards.load(spark, str(tmp_path / "s.csv"))
    assert [r.clause_ref for r in standards.replace_standard(a, b).collect()] == ["2"]
    with pytest.raises(ValueError, match="no catalogue"):
        standards.load(spark, "x.doc")


def test_listing_source(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text('{"remote_id": "r1", "name": "n", "version": "2"}\n{"remote_id": "r2", "version": "1"}\n')
    (tmp_path / "2.jsonl").write_text('{"remote_id": "r3", "version": "1", "content": "text"}\n')
    spark.dataSource.register(connectors.Listing)
    got = spark.read.format("listing").option("path", str(tmp_path)).load()
    known = spark.createDataFrame([("r1", "1"), ("r2", "1"), ("r9", "1")], "remote_id string, version string")
    assert rows(connectors.sync_plan(got, known)) == [("r1", "fetch"), ("r2", "keep"), ("r3", "fetch"), ("r9", "drop")]


def test_router_isolates_failures(spark, tmp_path):
    spark.createDataFrame([("a", "RAW"), ("b", "DELETED"), ("c", None)], "path string, status string").write.parquet(str(tmp_path / "in"))
    r, seen = events.Router(), []

    def fails(_):
        raise RuntimeError("no")

    r.subscribe(fails)
    r.subscribe(lambda b: seen.extend(x.path for x in b.collect()), ["RAW", "CHANGED"])
    stream = spark.readStream.schema("path string, status string").parquet(str(tmp_path / "in"))
    r.run(stream, str(tmp_path / "cp")).awaitTermination()
    assert seen == ["a"] and r.failures == ["no"]


def test_debounce_batch(spark):
    t = spark.createDataFrame([("a", 0), ("a", 1), ("a", 5), ("b", 1), ("b", None)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.k, r.n) for r in events.debounced(t, "k", "ts").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_prf_by_hand(spark):
    a, b = spark.createDataFrame([(i,) for i in (1, 2, 3, 3)], "k int"), spark.createDataFrame([(i,) for i in (2, 3, 4)], "k int")
    assert tuple(evaluation.prf1(a, b, ["k"]).first()) == (2, 0.666667, 0.666667, 0.666667)
    assert list(itertools.islice(a.columns, 1)) == ["k"]


def test_paths_have_no_longest(spark):
    e = spark.createDataFrame([(f"n{i:02}", "p", f"n{i + 1:02}") for i in range(34)], "source string, predicate string, target string")
    assert graph.shortest_path(e, "n00", "n34").count() == 35


def test_rare_tokens_find_all_similar_names(spark):
    rng = random.Random(5)
    words = ["pump", "valve", "steel", "grade", "a", "b", "old", "new", "main", "spare"]
    names_ = sorted({" ".join(rng.sample(words, rng.randrange(1, 6))) for _ in range(90)})
    df = spark.createDataFrame([(f"i{k}", "K", n) for k, n in enumerate(names_)], "id string, kind string, name string")
    p = resolution.prepared(df)
    every = resolution._side(p, "l").crossJoin(resolution._side(p, "r")).where("l_id < r_id").select("l_id", "r_id", F.round(resolution._score(), 6).alias("score")).where("score >= 0.88")
    assert rows(resolution.blocked_pairs(df, 0.88)) == rows(every) != []
    left, right = df.where("id < 'i5'"), df.where("id >= 'i5'")
    both = every.join(df.select(F.col("id").alias("l_id"), F.col("name").alias("ln")), "l_id").join(df.select(F.col("id").alias("r_id"), F.col("name").alias("rn")), "r_id")
    wanted = {tuple(sorted((r.ln, r.rn))) for r in both.collect() if (r.l_id < "i5") != (r.r_id < "i5")}
    assert {tuple(sorted((r.a, r.b))) for r in resolution.similar_pairs(left, right, 0.88).collect()} == wanted


def test_ends_resolve_by_likeness(spark):
    surface = spark.createDataFrame([("release governance board", "o1"), ("customer data", "o2"), ("", "o3")], "norm string, object_id string")
    ends = spark.createDataFrame([("Release Governance Board!",), ("Governance Board Release Plan",), ("Customer Data Platform",), ("nothing alike",), (None,), ("",)], "name string")
    got = dict(rows(resolution.resolved_ends(ends, surface)))
    assert got["release governance board"] == "o1" and got["governance board release plan"] == "o1" and got["customer data platform"] == "o2" and len(got) == 3


def test_focus_terms_keep_quotes(spark):
    q = spark.createDataFrame([('What is "Change Window" and \'Release Plan\' for Release?',), ("nothing",)], "question string")
    labels = spark.createDataFrame([("Release",), ("release plan",)], "label string")
    assert sorted(r.label for r in retrieval.focus_terms(q, labels).collect()) == ["Change Window", "release plan"]


def test_archived_configured_and_reviewed(spark):
    from lodestack.functions import measures

    one, lit = spark.range(1), F.lit
    r = one.select(times.freshness_state(lit(10.0), archived=lit(True)).alias("a"), times.freshness(lit(10.0), archived=lit(True)).alias("f"), urls.target_system(lit("https://wiki.acme.test/x"), {"intranet": ["acme.test"]}).alias("s"), urls.target_system(lit("https://other.test/x"), {"intranet": ["acme.test"]}).alias("o"), measures.confidence(lit(1.0), lit(8), lit(12), lit(1.0), rejected=lit(True)).alias("c"), measures.confidence(lit(0.5), lit(8), lit(12), lit(1.0), approved=lit(True)).alias("d")).first()
    assert tuple(r) == ("ARCHIVED", 0.0, "intranet", "external_web", 0.4, 0.825)
