"""Queries over graphs: named patterns, neighbourhoods, paths, components and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import graph as G
from lodestack.plans import substrate as S
from lodestack.plans.registry import Query
from lodestack.runtime import table

HUB, FAR = "nation/3", "supplier/7"
#: Two nations of one region, so that there is a path between them.
GOAL = "nation/18"


def _ve(spark, d):  # noqa: ANN001, ANN202
    return S.vertices(spark, d), S.hierarchy(spark, d)


def _triples(spark, d):  # noqa: ANN001, ANN202
    return G.triples(*_ve(spark, d))


TRIPLES = f"""{S.VERTICES}, {S.HIERARCHY}, t AS (SELECT id AS s, 'type' AS p, kind AS o FROM v WHERE kind IS NOT NULL UNION SELECT id, 'label', label FROM v WHERE label IS NOT NULL UNION SELECT * FROM h)"""
BOTH = f"{S.VERTICES}, {S.HIERARCHY}, sym AS (SELECT source AS a, target AS b, predicate, 'out' AS direction FROM h UNION SELECT target, source, predicate, 'in' FROM h)"


def _compliance(spark, d):  # noqa: ANN001, ANN202
    """Triples of requirements, the standards they belong to, the controls that meet them, and evidence."""
    a = table(spark, d, "compliance_assessments").where("requirement_object_id IS NOT NULL")
    req, std = F.col("requirement_object_id"), F.regexp_replace("requirement_object_id", r"(_\d+)+$", "")
    e = table(spark, d, "compliance_assessment_evidence").distinct().join(a.select(F.col("id").alias("assessment_id"), "control_object_id"), "assessment_id").where("control_object_id IS NOT NULL")
    ev = F.concat(F.lit("evidence/"), F.col("id").cast("string"))
    parts = [
        a.select(req.alias("s"), F.lit("type").alias("p"), F.lit("Requirement").alias("o")),
        a.select(req, F.lit("mandated_by"), std),
        a.select(std, F.lit("type"), F.lit("Standard")),
        a.where("control_object_id IS NOT NULL AND status = 'SATISFIED'").select("control_object_id", F.lit("satisfies"), req),
        a.where("control_object_id IS NOT NULL").select("control_object_id", F.lit("type"), F.lit("Control")),
        e.select("control_object_id", F.lit("supported_by"), ev),
        e.where("quote IS NOT NULL").select(ev, F.lit("quote"), "quote"),
        e.where("artifact_id IS NOT NULL").select(ev, F.lit("source_artifact"), "artifact_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


CT = r"""a AS (SELECT *, regexp_replace(requirement_object_id, '(_\d+)+$', '') AS std FROM compliance_assessments WHERE requirement_object_id IS NOT NULL),
e AS (SELECT x.*, control_object_id FROM (SELECT DISTINCT * FROM compliance_assessment_evidence) x JOIN a ON x.assessment_id = a.id WHERE control_object_id IS NOT NULL),
sat AS (SELECT DISTINCT control_object_id AS control, requirement_object_id AS requirement FROM a WHERE control_object_id IS NOT NULL AND status = 'SATISFIED'),
req AS (SELECT DISTINCT requirement_object_id AS requirement, std AS standard FROM a)"""


def _coverage(spark, d):  # noqa: ANN001, ANN202
    rows = G.Pattern(_compliance(spark, d)).match("?standard", "type", "Standard").optional("?requirement", "mandated_by", "?standard").optional("?control", "satisfies", "?requirement").rows
    return rows.groupBy("standard").agg(F.count_distinct("requirement").alias("requirements"), F.count_distinct(F.when(F.col("control").isNotNull(), F.col("requirement"))).alias("satisfied"))


def _kind(kind):  # noqa: ANN001, ANN202
    return Query(
        lambda s, d: G.Pattern(_triples(s, d)).match("?id", "type", kind).optional("?id", "label", "?label").rows.select("id", "label"),
        f"WITH {TRIPLES} SELECT x.s AS id, l.o AS label FROM t x LEFT JOIN t l ON l.s = x.s AND l.p = 'label' WHERE x.p = 'type' AND x.o = '{kind}'",
    )


REACH = f"""WITH RECURSIVE {BOTH}, w AS (SELECT '{FAR}' AS id, 0 AS dist UNION SELECT sym.b, w.dist + 1 FROM w JOIN sym ON w.id = sym.a WHERE w.dist < 3), r AS (SELECT id, min(dist) AS dist FROM w GROUP BY id)"""


def _seed(spark, *ids):  # noqa: ANN001, ANN202
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _graph_of(li):  # noqa: ANN001, ANN202
    e = li.select(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("source"), F.lit("related_to").alias("predicate"), F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("target"))
    v = e.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumns({"kind": F.split_part("id", F.lit("/"), F.lit(1)), "label": F.col("id"), "confidence": F.lit(1.0)})
    return v, e


def _part_orders(spark, d):  # noqa: ANN001, ANN202
    """The graph of all parts and the orders they are in."""
    return _graph_of(table(spark, d, "lineitem"))


QUERIES = {
    "graph_triples": Query(lambda s, d: _triples(s, d).where("p <> 'confidence'"), f"WITH {TRIPLES} SELECT s, p, o FROM t"),
    "graph_named_nations": _kind("Nation"),
    "graph_named_suppliers": _kind("Supplier"),
    "graph_named_relationships": Query(
        lambda s, d: G.Pattern(_triples(s, d)).match("?source", "depends_on", "?target").match("?source", "label", "?source_label").match("?target", "label", "?target_label").rows.select("source", "source_label", "target", "target_label"),
        f"WITH {TRIPLES} SELECT x.s AS source, a.o AS source_label, x.o AS target, b.o AS target_label FROM t x JOIN t a ON a.s = x.s AND a.p = 'label' JOIN t b ON b.s = x.o AND b.p = 'label' WHERE x.p = 'depends_on'",
    ),
    "graph_named_top_relationships": Query(
        lambda s, d: _triples(s, d).where(~F.col("p").isin("type", "label", "confidence")).groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n")),
        f"WITH {TRIPLES} SELECT p AS predicate, count(*) AS n FROM t WHERE p NOT IN ('type', 'label') GROUP BY 1",
    ),
    "graph_named_domains": Query(
        lambda s, d: G.Pattern(_triples(s, d)).match("?id", "type", "?kind").rows.groupBy("kind").agg(F.count("*").alias("n")), f"WITH {TRIPLES} SELECT o AS kind, count(*) AS n FROM t WHERE p = 'type' GROUP BY 1"
    ),
    "graph_named_related_same_type": Query(
        lambda s, d: G.related_of_kind(_triples(s, d)),
        f"WITH {TRIPLES} SELECT DISTINCT x.s AS a, y.s AS b, x.o AS via FROM t x JOIN t y ON x.o = y.o JOIN t k ON k.s = x.s AND k.p = 'type' JOIN t l ON l.s = y.s AND l.p = 'type' AND l.o = k.o WHERE x.p IN ('depends_on', 'supports') AND y.p = 'supports' AND x.s <> y.s",
    ),
    "graph_named_evidence_for_object": Query(
        lambda s, d: G.Pattern(_compliance(s, d)).match("?control", "supported_by", "?evidence").match("?evidence", "source_artifact", "?artifact").optional("?evidence", "quote", "?quote").rows.select("control", "evidence", "artifact", "quote"),
        f"WITH {CT} SELECT DISTINCT control_object_id AS control, 'evidence/' || id AS evidence, artifact_id AS artifact, quote FROM e WHERE artifact_id IS NOT NULL",
    ),
    "graph_named_controls_satisfying": Query(
        lambda s, d: G.Pattern(_compliance(s, d)).match("?control", "satisfies", "?requirement").match("?control", "type", "Control").optional("?requirement", "mandated_by", "?standard").rows.select("control", "requirement", "standard"),
        f"WITH {CT} SELECT control, sat.requirement, standard FROM sat LEFT JOIN req ON sat.requirement = req.requirement",
    ),
    "graph_named_compliance_gaps": Query(
        lambda s, d: G.Pattern(_compliance(s, d)).match("?requirement", "type", "Requirement").absent("?control", "satisfies", "?requirement").rows.select("requirement"),
        f"WITH {CT} SELECT requirement FROM req WHERE requirement NOT IN (SELECT requirement FROM sat)",
    ),
    "graph_named_compliance_coverage": Query(
        _coverage, f"WITH {CT} SELECT standard, count(DISTINCT req.requirement) AS requirements, count(DISTINCT sat.requirement) AS satisfied FROM req LEFT JOIN sat ON sat.requirement = req.requirement GROUP BY 1"
    ),
    "graph_named_requirements_for_standard": Query(
        lambda s, d: G.Pattern(_compliance(s, d)).match("?standard", "type", "Standard").match("?requirement", "mandated_by", "?standard").optional("?control", "satisfies", "?requirement").rows.select("standard", "requirement", "control"),
        f"WITH {CT} SELECT standard, req.requirement, control FROM req LEFT JOIN sat ON sat.requirement = req.requirement",
    ),
    "graph_neighbors": Query(
        lambda s, d: (lambda v, e: G.neighbours(e, v, HUB))(*_ve(s, d)), f"WITH {BOTH} SELECT predicate, direction, v.id, kind, label FROM sym JOIN v ON sym.b = v.id WHERE a = '{HUB}'"
    ),
    "graph_impact": Query(
        lambda s, d: (lambda v, e: G.impact(e, v, HUB))(*_ve(s, d)),
        f"WITH {BOTH}, n AS (SELECT DISTINCT b FROM sym WHERE a = '{HUB}' AND b <> a) SELECT kind, count(*) AS n, string_agg(label, '; ' ORDER BY label) AS labels FROM n JOIN v ON n.b = v.id GROUP BY kind",
    ),
    "graph_bfs": Query(lambda s, d: G.distances(S.hierarchy(s, d), _seed(s, FAR), 3), f"{REACH} SELECT id, dist FROM r"),
    "graph_ego": Query(
        lambda s, d: G.ego(S.hierarchy(s, d), _seed(s, FAR), 2), f"{REACH} SELECT source, predicate, target FROM h WHERE source IN (SELECT id FROM r WHERE dist <= 2) AND target IN (SELECT id FROM r WHERE dist <= 2)"
    ),
    "graph_shortest_path": Query(
        lambda s, d: G.shortest_path(S.hierarchy(s, d), HUB, GOAL),
        # Least parents from the goal backwards, along the distances from the start.
        f"""WITH RECURSIVE {BOTH}, w AS (SELECT '{HUB}' AS id, 0 AS dist UNION SELECT sym.b, w.dist + 1 FROM w JOIN sym ON w.id = sym.a WHERE w.dist < 6), r AS (SELECT id, min(dist) AS dist FROM w GROUP BY id),
p AS (SELECT r.id, r.dist, min(q.id) AS parent FROM r JOIN sym ON sym.b = r.id JOIN r q ON q.id = sym.a AND q.dist = r.dist - 1 GROUP BY 1, 2),
b AS (SELECT id, dist, parent FROM p WHERE id = '{GOAL}' UNION ALL SELECT p.id, p.dist, p.parent FROM b JOIN p ON p.id = b.parent)
SELECT dist AS step, id FROM b UNION ALL SELECT 0, '{HUB}' WHERE EXISTS (SELECT 1 FROM b)""",
    ),
    # The whole table is too much for recursive SQL; brute force on small graphs is in the tests.
    "graph_components": Query(lambda s, d: (lambda v, e: G.component_of(e, v))(*_part_orders(s, d))),
    "graph_summary": Query(lambda s, d: (lambda v, e: G.summary(e, v))(*_part_orders(s, d))),
    "graph_degree_metrics": Query(
        lambda s, d: (lambda v, e: G.degrees(e, v))(*_ve(s, d)),
        f"""WITH {BOTH}, s AS (SELECT DISTINCT source, target FROM h), d AS (SELECT id, (SELECT count(*) FROM s WHERE target = v.id) AS in_degree, (SELECT count(*) FROM s WHERE source = v.id) AS out_degree FROM v)
SELECT id, in_degree, out_degree, in_degree + out_degree AS degree, round((in_degree + out_degree) / ((SELECT count(*) FROM v) - 1), 6) AS centrality FROM d""",
    ),
    "graph_by_kind": Query(
        lambda s, d: (lambda v, e: G.by_kind(e, v).select("kind", "vertices", "edges", "top"))(*_ve(s, d)),
        f"""WITH {S.VERTICES}, {S.HIERARCHY}, q AS (SELECT row_number() OVER () AS e, source, target FROM h), x AS (SELECT e, source AS id FROM q UNION ALL SELECT e, target FROM q), k AS (SELECT x.*, kind FROM x JOIN v ON x.id = v.id),
r AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, id) AS r FROM k GROUP BY kind, id), g AS (SELECT kind, string_agg(id, '; ' ORDER BY r) AS top FROM r WHERE r <= 5 GROUP BY kind),
n AS (SELECT kind, count(*) AS vertices FROM v GROUP BY kind), m AS (SELECT kind, count(DISTINCT e) AS edges FROM k GROUP BY kind)
SELECT n.kind, vertices, coalesce(edges, 0) AS edges, coalesce(top, '') AS top FROM n LEFT JOIN m ON n.kind = m.kind LEFT JOIN g ON n.kind = g.kind""",
    ),
    "graph_betweenness": Query(lambda s, d: G.betweenness(S.hierarchy(s, d)).select("id", F.round("betweenness", 4).alias("betweenness"))),
    "graph_communities": Query(lambda s, d: G.communities(S.hierarchy(s, d))),
}
