"""Queries over what answers hold, over addresses, exports and comparisons of objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import names
from lodestack.operators import exports
from lodestack.operators import graph as G
from lodestack.operators import responses as P
from lodestack.operators import retrieval as R
from lodestack.operators import semantic as M
from lodestack.plans import substrate as S
from lodestack.plans.graph import BOTH, FAR, GOAL, HUB
from lodestack.plans.knowledge import _edges, _objects
from lodestack.plans.registry import Query
from lodestack.plans.responses import answers
from lodestack.plans.retrieval import QUESTIONS, _list
from lodestack.runtime import table

PARTS = "p AS (SELECT p_partkey AS artifact_id, * FROM part WHERE p_partkey % 17 <> 0)"


def _frequent(name, column, rows, kind=None):  # noqa: ANN001, ANN202
    """How often names come up, spellings that differ in case together. rows: SQL of artifact_id, name, confidence."""

    def run(spark, d):  # noqa: ANN001, ANN202
        found = P.rows_of(P.parsed_answers(answers(spark, d)), name)
        return M.name_frequency(found.where(F.col("entity_type") == kind) if kind else found, column)

    return Query(run, f"WITH {PARTS}, x AS ({rows}) SELECT min(name) AS name, count(*) AS mentions, count(DISTINCT artifact_id) AS documents, round(avg(confidence), 3) AS average_confidence FROM x GROUP BY lower(name)")


def _addresses(spark, d):  # noqa: ANN001, ANN202
    o = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("kind"), names.object_id(F.col("p_type"), F.col("p_name")).alias("object_id"))
    return o.select("p_partkey", names.object_uri(F.col("kind"), F.col("object_id")).alias("object"), names.class_uri(F.col("kind")).alias("class"), names.evidence_uri(F.col("p_partkey")).alias("evidence"), names.object_local_name(F.col("kind"), F.col("object_id")).alias("local"))


def _predicates(spark, d):  # noqa: ANN001, ANN202
    p = _edges(spark, d).select("predicate").distinct()
    uri = names.predicate_uri(F.col("predicate"))
    return p.select("predicate", uri.alias("uri"), names.predicate_label(uri).alias("label"))


def _answers_said(spark, d):  # noqa: ANN001, ANN202
    k, name = F.col("p_partkey"), F.col("p_name")
    said = F.when(k % 5 == 0, "YES.").when(k % 5 == 1, F.concat(F.lit("<think>no, or yes?</think> No, "), name)).when(k % 5 == 2, F.concat(F.lit("<THINK>\nno\n</THINK>\nyes: "), name)).when(k % 5 == 3, "eyes only")
    return table(spark, d, "part").select("p_partkey", names.says_yes(said).alias("merge"))


def _kg_nodes(spark, d):  # noqa: ANN001, ANN202
    m = table(spark, d, "lineitem").groupBy(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("id")).agg(F.count_distinct("l_orderkey").alias("documents"), F.count("*").alias("mentions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _objects(spark, d).where("status <> 'REJECTED'").join(m, "id", "left").select("id", F.col("name").alias("label"), F.col("kind").alias("type"), "confidence", "status", zero("documents"), zero("mentions"))


def _kg_edges(spark, d):  # noqa: ANN001, ANN202
    ok = _objects(spark, d).where("status <> 'REJECTED'").select("id")
    e = _edges(spark, d).where("review_status <> 'REJECTED'").join(ok.withColumnRenamed("id", "source"), "source", "left_semi").join(ok.withColumnRenamed("id", "target"), "target", "left_semi")
    return e.select("id", "source", "target", "predicate", "confidence", F.col("review_status").alias("status"))


def _store_sql():  # noqa: ANN202
    from lodestack.plans.knowledge import STORE

    return STORE


def _triples(spark, d):  # noqa: ANN001, ANN202
    return G.triples(S.vertices(spark, d), S.hierarchy(spark, d)).where("p <> 'confidence'")


T = f"{S.VERTICES}, {S.HIERARCHY}, t AS (SELECT id AS s, 'type' AS p, kind AS o FROM v WHERE kind IS NOT NULL UNION SELECT id, 'label', label FROM v WHERE label IS NOT NULL UNION SELECT * FROM h)"
ADDRESS = "'https://kg.example/' || replace({}, ' ', '_')"
LEFT, RIGHT = "nation/3", "nation/7"


def _path(spark, d):  # noqa: ANN001, ANN202
    e = S.hierarchy(spark, d)
    return R.path_facts(G.shortest_path(e, HUB, GOAL), e, S.vertices(spark, d))


QUERIES = {
    "sem_top_capabilities": _frequent("capabilities", "name", "SELECT artifact_id, p_name AS name, 0.9::DOUBLE AS confidence FROM p"),
    "sem_top_platforms": _frequent("entities", "name", "SELECT artifact_id, p_name AS name, 1::DOUBLE AS confidence FROM p", "Platform"),
    "sem_top_concepts": _frequent("entities", "name", "SELECT artifact_id, p_brand AS name, 0.5::DOUBLE AS confidence FROM p", "Concept"),
    "sem_decision_themes": _frequent("decisions", "decision_text", "SELECT artifact_id, 'Adopt ' || p_name || '; then stop' AS name, 0.5::DOUBLE AS confidence FROM p UNION ALL SELECT artifact_id, p_name, 0.5 FROM p"),
    "sem_risk_themes": _frequent("risks", "risk_description", "SELECT artifact_id, 'Loss of ' || p_name || '. More' AS name, 0.25::DOUBLE AS confidence FROM p"),
    "sem_fuzzily_merged": Query(lambda s, d: M.fuzzily_merged(M.exploded_domains(table(s, d, "document_classifications").where("artifact_id IS NOT NULL").distinct()))),
    "fn_addresses": Query(
        _addresses,
        f"""WITH x AS (SELECT p_partkey, p_type, {S.slug_sql('p_type')} AS k, {S.slug_sql('p_name')} AS n FROM part)
SELECT p_partkey, 'https://kg.example/' || k || '/' || n AS object, 'https://kg.example/' || p_type AS class, 'https://kg.example/evidence/' || p_partkey AS evidence, n AS local FROM x""",
    ),
    "fn_predicates": Query(
        _predicates, f"WITH {_store_sql()} SELECT DISTINCT predicate, 'https://kg.example/' || CASE predicate WHEN 'depends_on' THEN 'dependsOn' WHEN 'related_to' THEN 'relatedTo' ELSE predicate END AS uri, predicate AS label FROM e"
    ),
    "fn_says_yes": Query(_answers_said, "SELECT p_partkey, p_partkey % 5 IN (0, 2) AS merge FROM part"),
    "export_nodes": Query(
        _kg_nodes,
        f"WITH {_store_sql()} SELECT id, name AS label, kind AS type, confidence, status, count(DISTINCT l_orderkey) AS documents, count(l_orderkey) AS mentions FROM o LEFT JOIN lineitem ON id = 'part/' || l_partkey WHERE status <> 'REJECTED' GROUP BY 1, 2, 3, 4, 5",
    ),
    "export_edges": Query(
        _kg_edges,
        f"WITH {_store_sql()} SELECT id, source, target, predicate, confidence, review_status AS status FROM e WHERE review_status <> 'REJECTED' AND source IN (SELECT id FROM o WHERE status <> 'REJECTED') AND target IN (SELECT id FROM o WHERE status <> 'REJECTED')",
    ),
    "export_turtle": Query(
        lambda s, d: exports.turtle(_triples(s, d), ["label"]),
        f"""WITH {T}, x AS (SELECT s, p, string_agg(CASE WHEN p = 'label' THEN '"' || o || '"' ELSE '<' || {ADDRESS.format('o')} || '>' END, ', ' ORDER BY CASE WHEN p = 'label' THEN '"' || o || '"' ELSE '<' || {ADDRESS.format('o')} || '>' END) AS o FROM t GROUP BY 1, 2)
SELECT '<' || {ADDRESS.format('s')} || '> ' || string_agg('<https://kg.example/' || p || '> ' || o, ' ;' || chr(10) || '    ' ORDER BY '<https://kg.example/' || p || '> ' || o) || ' .' AS value FROM x GROUP BY s""",
    ),
    "export_json_ld": Query(
        lambda s, d: exports.json_ld(_triples(s, d), ["label"]),
        f"""WITH {T}, y AS (SELECT s, p, CASE WHEN p = 'label' THEN '{{"@value":"' || o || '"}}' ELSE '{{"@id":"' || {ADDRESS.format('o')} || '"}}' END AS o FROM t), x AS (SELECT s, '"https://kg.example/' || p || '":[' || string_agg(o, ',' ORDER BY o) || ']' AS e FROM y GROUP BY s, p)
SELECT '{{"@id":"' || {ADDRESS.format('s')} || '",' || string_agg(e, ',' ORDER BY e) || '}}' AS value FROM x GROUP BY s""",
    ),
    "export_node_link": Query(
        lambda s, d: exports.node_link(S.vertices(s, d), S.hierarchy(s, d)),
        f"""WITH {S.VERTICES}, {S.HIERARCHY} SELECT 'nodes' AS part, '{{"id":"' || id || '","label":"' || label || '","type":"' || kind || '"}}' AS value FROM v
UNION ALL SELECT 'links', '{{"source":"' || source || '","target":"' || target || '","predicate":"' || predicate || '"}}' FROM h""",
    ),
    "rag_asked_for": Query(
        lambda s, d: R.asked_for(s.createDataFrame([(x,) for x in [*QUESTIONS, "Which platform teams cite this decision?", "Is any technology a risk?"]], "question string")),
        f"""SELECT question, CASE WHEN contains(lower(question), 'decision') THEN 'Decision' WHEN contains(lower(question), 'risk') THEN 'Risk' END AS object_type,
lower(question) SIMILAR TO '.*(evidence|cite).*' AS wants_evidence FROM {_list([*QUESTIONS, "Which platform teams cite this decision?", "Is any technology a risk?"], "question")}""",
    ),
    "rag_descriptions": Query(
        lambda s, d: R.descriptions(S.vertices(s, d), G.distances(S.hierarchy(s, d), s.createDataFrame([(FAR,)], "id string"), 2)),
        f"WITH {BOTH}, w AS (SELECT '{FAR}' AS id UNION SELECT b FROM sym WHERE a = '{FAR}' UNION SELECT y.b FROM sym x JOIN sym y ON x.b = y.a WHERE x.a = '{FAR}') SELECT id, label, kind FROM v WHERE id IN (SELECT id FROM w)",
    ),
    "rag_compare": Query(
        lambda s, d: R.compared(S.hierarchy(s, d), LEFT, RIGHT),
        f"WITH {BOTH}, n AS (SELECT DISTINCT a, b FROM sym WHERE a IN ('{LEFT}', '{RIGHT}') AND b NOT IN ('{LEFT}', '{RIGHT}')) SELECT b AS id, CASE WHEN count(*) = 2 THEN 'both' WHEN min(a) = '{LEFT}' THEN 'left' ELSE 'right' END AS side FROM n GROUP BY 1",
    ),
    "rag_path_facts": Query(
        _path,
        f"""WITH RECURSIVE {BOTH}, w AS (SELECT '{HUB}' AS id, 0 AS dist UNION SELECT sym.b, w.dist + 1 FROM w JOIN sym ON w.id = sym.a WHERE w.dist < 6), r AS (SELECT id, min(dist) AS dist FROM w GROUP BY id),
p AS (SELECT r.id, r.dist, min(q.id) AS parent FROM r JOIN sym ON sym.b = r.id JOIN r q ON q.id = sym.a AND q.dist = r.dist - 1 GROUP BY 1, 2),
b AS (SELECT id, dist, parent FROM p WHERE id = '{GOAL}' UNION ALL SELECT p.id, p.dist, p.parent FROM b JOIN p ON p.id = b.parent)
SELECT dist - 1 AS step, x.label AS source_label, min(predicate) AS predicate, y.label AS target_label, bool_or(source = parent) AS forward FROM b JOIN h ON (source = parent AND target = b.id) OR (source = b.id AND target = parent) JOIN v x ON x.id = parent JOIN v y ON y.id = b.id GROUP BY 1, 2, 4""",
    ),
    "scan_latest_runs": Query(
        lambda s, d: table(s, d, "link_scan_runs").distinct().where("completed_at IS NOT NULL").groupBy("scan_root").agg(F.max_by("id", F.struct(F.coalesce("started_at", F.lit("1900-01-01").cast("timestamp_ntz")), "id")).alias("id"), F.count("*").alias("runs")),
        "SELECT scan_root, arg_max(id, {'t': coalesce(started_at, TIMESTAMP '1900-01-01'), 'i': id}) AS id, count(*) AS runs FROM (SELECT DISTINCT * FROM link_scan_runs) WHERE completed_at IS NOT NULL GROUP BY 1",
    ),
}
