"""Queries of retrieval, documents, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import measures
from lodestack.operators import documents as D
from lodestack.operators import evaluation as E
from lodestack.operators import formulas
from lodestack.operators import retrieval as R
from lodestack.plans import substrate as S
from lodestack.plans.catalog import FILES, files
from lodestack.plans.registry import Query
from lodestack.plans.semantic import ROWS
from lodestack.runtime import table

# Written out here, so that the SQL doesn't follow the operator's table.
ENDINGS = [x.split() for x in """py python, pyi python, js javascript, jsx javascript, mjs javascript, cjs javascript, ts typescript, tsx tsx, go go, rs rust, java java, c c, h c,
cc cpp, cpp cpp, cxx cpp, hpp cpp, hh cpp, hxx cpp, cs c_sharp, rb ruby, php php, sh bash, bash bash""".split(",")]

QUESTIONS = [
    "How does Supplier#000000001 depend on NATION_1?",
    "Compare NATION_10 with NATION_2, please.",
    "What is the impact of ASIA on it?",
    "Which evidence backs this up?",
    "Give me an overview of MIDDLE EAST",
    "Who owns Customer#000000012?",
]
TERMS = ["nation/3", "asia", "supplier#00000001", "no such thing", "NATION_1"]


def _list(values: list[str], column: str) -> str:
    return f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {column})"


def _frame(spark, values, column):  # noqa: ANN001, ANN202
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def _any(words: list[str]) -> str:
    return " OR ".join(f"contains(low, '{w}')" for w in words)


def _case(table_, otherwise: str) -> str:  # noqa: ANN001
    return "CASE " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in table_) + f" ELSE {otherwise} END"


INTENT = f"""SELECT question, {_case(R.REASONING, "'lookup'")} AS reasoning, {_case(R.PREDICATES, 'NULL')} AS predicate,
list_has_any(regexp_split_to_array(regexp_replace(low, '[?,]', ' ', 'g'), '\\s+'), ['that', 'those', 'them', 'it', 'this', 'these']) AS has_referent FROM (SELECT question, lower(question) AS low FROM {_list(QUESTIONS, 'question')})"""

FOCUS = f"""WITH {S.VERTICES}, q AS {_list(QUESTIONS, 'question')}, h AS (SELECT DISTINCT question, label, instr(lower(question), lower(label)) - 1 AS position FROM q, v WHERE contains(lower(question), lower(label)))
SELECT question, label, position FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.question = h.question AND lower(g.label) <> lower(h.label) AND contains(lower(g.label), lower(h.label)))"""

RESOLVE = f"""WITH {S.VERTICES}, t AS {_list(TERMS, 'term')}, h AS (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY CASE WHEN id = term THEN 0 WHEN lower(label) = lower(term) THEN 1 ELSE 2 END, length(label), id) AS rn
FROM t, v WHERE id = term OR contains(lower(label), lower(term))) SELECT t.term, h.id FROM t LEFT JOIN h ON t.term = h.term AND rn = 1"""

KEPT = f"""{S.VERTICES}, {S.HIERARCHY}, sym AS (SELECT source AS a, target AS b FROM h UNION SELECT target, source FROM h), w AS (SELECT 'supplier/7' AS id, 0 AS dist UNION SELECT sym.b, w.dist + 1 FROM w JOIN sym ON w.id = sym.a WHERE w.dist < 2),
r AS (SELECT id, min(dist) AS dist FROM w GROUP BY id), k AS (SELECT r.id, dist, confidence FROM r JOIN v ON r.id = v.id ORDER BY dist, confidence DESC NULLS LAST, r.id LIMIT 40)"""


def _kept(spark, d):  # noqa: ANN001, ANN202
    v, e = S.vertices(spark, d), S.hierarchy(spark, d)
    return R.kept_objects(e, v, _frame(spark, ["supplier/7"], "id"))


def _links(spark, d):  # noqa: ANN001, ANN202
    return R.kept_edges(S.hierarchy(spark, d), _kept(spark, d))


LINKS = f"WITH RECURSIVE {KEPT} SELECT DISTINCT source, predicate, target, least(a.confidence, b.confidence) AS confidence FROM h JOIN k a ON a.id = source JOIN k b ON b.id = target"


def _turns(spark, d):  # noqa: ANN001, ANN202
    """Events of a user as turns of a conversation; errors name nothing and every third one refers back."""
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, "And what about that?").otherwise("Go on")
    return e.select(F.col("user_id").alias("conv"), F.col("event_id").alias("turn"), text.alias("text"), F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("objects"))


CHUNKS = """SELECT doc_id, s // 900 AS n, length(substr(t, s + 1, 1000)) AS chars, md5(substr(t, s + 1, 1000)) AS hash FROM (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 1000 THEN [0::BIGINT] ELSE range(0, length(t), 900) END) AS s FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


def _profile_sql() -> str:
    terms = " + ".join(f"((length(low) - length(replace(low, '{t}', ''))) // {len(t)})" for t in measures.NORMATIVE)
    formula = measures.FORMULA.replace("'", "''")
    return f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS body, lower(coalesce(text, '')) AS low, regexp_replace(coalesce(text, ''), '[\\s\\x{{85}}\\p{{Z}}\\x0b]+', '', 'g') AS solid FROM documents),
c AS (SELECT doc_id, length(body) AS char_count, CASE WHEN length(solid) > 0 THEN length(regexp_replace(solid, '[\\p{{L}}\\p{{N}}]+', '', 'g')) / length(solid) ELSE 0 END AS ratio,
  len(regexp_extract_all(body, '{formula}')) AS equation_hits, ({terms}) AS standard_hits FROM b)
SELECT doc_id, char_count, round(ratio, 4) AS symbol_ratio, equation_hits, standard_hits, round(least(1, 0.35::DOUBLE * least(1, char_count / 60000) + 0.20::DOUBLE * least(1, ratio / 0.30::DOUBLE) + 0.25::DOUBLE * least(1, equation_hits / 5) + 0.20::DOUBLE * least(1, standard_hits / 8)), 4) AS score,
equation_hits >= 2 OR standard_hits >= 4 AS forces_deep FROM c"""


def _chunks(spark, d):  # noqa: ANN001, ANN202
    c = table(spark, d, "documents").select("doc_id", F.explode(measures.cut_to_chunks(F.col("text"), 1000, 100)).alias("c"))
    return c.select("doc_id", F.col("c.n").cast("long").alias("n"), F.length("c.chunk").alias("chars"), F.md5("c.chunk").alias("hash"))


def _domains(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "document_classifications").distinct()


QUERIES = {
    "rag_intent": Query(lambda s, d: R.intent(_frame(s, QUESTIONS, "question")), INTENT),
    "rag_focus_terms": Query(lambda s, d: R.focus_terms(_frame(s, QUESTIONS, "question"), S.vertices(s, d)), FOCUS),
    "rag_resolve_terms": Query(lambda s, d: R.resolve_terms(_frame(s, TERMS, "term"), S.vertices(s, d)), RESOLVE),
    "rag_expand": Query(_kept, f"WITH RECURSIVE {KEPT} SELECT * FROM k"),
    "rag_links": Query(_links, LINKS),
    "rag_confidence": Query(
        lambda s, d: R.answer_confidence(_kept(s, d), _links(s, d), table(s, d, "compliance_assessment_evidence").where("assessment_id = 1"), 1, 2),
        f"""WITH RECURSIVE {KEPT}, l AS (SELECT DISTINCT source, predicate, target, least(a.confidence, b.confidence) AS confidence FROM h JOIN k a ON a.id = source JOIN k b ON b.id = target), e AS (SELECT confidence FROM compliance_assessment_evidence WHERE assessment_id = 1),
m AS (SELECT (SELECT coalesce(avg(confidence), 0) FROM k WHERE dist = 0) AS o, (SELECT coalesce(avg(confidence), 0) FROM l) AS r, (SELECT count(*) FROM l) AS nr, (SELECT coalesce(avg(confidence), 0) FROM e) AS ev, (SELECT count(*) FROM e) AS ne),
c AS (SELECT *, 0.5 * CASE WHEN ne > 0 THEN 1 ELSE 0.5 END AS cov FROM m), s AS (SELECT *, round(greatest(0, least(1, CASE WHEN nr > 0 THEN 0.30 * o + 0.20 * r + 0.30 * ev + 0.20 * cov ELSE 0.30 * o + 0.50 * ev + 0.20 * cov END)), 3) AS score FROM c)
SELECT round(o, 3) AS object, round(r, 3) AS relationship, round(ev, 3) AS evidence, round(cov::DOUBLE, 3) AS coverage, score, CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS band FROM s""",
    ),
    "rag_context": Query(lambda s, d: R.context(_kept(s, d), S.vertices(s, d), _links(s, d))),
    "rag_follow_up": Query(
        lambda s, d: R.follow_ups(_turns(s, d)).select("conv", "turn", F.array_join("carried", ",").alias("carried")),
        """WITH t AS (SELECT user_id AS conv, event_id AS turn, event_id % 3 = 0 AS refers, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS o FROM events),
x AS (SELECT *, lag(coalesce(o, '')) OVER (PARTITION BY conv ORDER BY turn) AS p, row_number() OVER (PARTITION BY conv ORDER BY turn DESC) AS back FROM t)
SELECT conv, turn, CASE WHEN refers AND o IS NULL THEN coalesce(p, '') ELSE coalesce(o, '') END AS carried FROM x WHERE back <= 20""",
    ),
    "doc_chunks": Query(_chunks, CHUNKS),
    "doc_routing_profile": Query(lambda s, d: measures.profiled(table(s, d, "documents"), "doc_id"), _profile_sql()),
    "doc_clause_refs": Query(lambda s, d: table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(D.clause_references("text")).alias("position", "clause"))),
    "doc_clause_keywords": Query(
        lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)(?:clauses?|sub-?clauses?|sections?|paragraphs?|paras?|articles?|art\.|cl\.|sec\.|§)\s*(\d+(?:\.\d+)*)"), 1)).alias("clause")).distinct(),
        r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?i)(?:clauses?|sub-?clauses?|sections?|paragraphs?|paras?|articles?|art\.|cl\.|sec\.|§)\s*(\d+(?:\.\d+)*)', 1)) AS clause FROM documents",
    ),
    "doc_designations": Query(
        lambda s, d: table(s, d, "documents").where("text IS NOT NULL").select("doc_id", measures.mentions(F.col("text"), F.lit("Release Register")).alias("mentioned")).where("mentioned").select("doc_id"),
        r"SELECT doc_id FROM documents WHERE regexp_matches(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '(^|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}-])release register($|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}-])')",
    ),
    "doc_languages": Query(
        lambda s, d: files(s, d).withColumn("language", D.language(F.col("filename"))).groupBy("language").agg(F.count("*").alias("n")),
        f"WITH {FILES}, x AS (SELECT lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM files) SELECT CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ENDINGS) + " END AS language, count(*) AS n FROM x GROUP BY 1",
    ),
    "doc_formulas": Query(
        lambda s, d: formulas.formulas(table(s, d, "part").select("p_partkey", F.concat(F.lit("sqrt("), F.regexp_replace("p_name", " ", "_"), F.lit(") * "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 5 == 0, ".real").otherwise(" + pi")).alias("formula")), "p_partkey", "formula").select("p_partkey", "valid", "function_code", "ast_json", "variables"),
        """WITH x AS (SELECT p_partkey, replace(p_name, ' ', '_') AS v, p_size::VARCHAR AS n, p_size % 5 <> 0 AS ok FROM part)
SELECT p_partkey, ok AS valid, CASE WHEN ok THEN 'def evaluate(' || v || '):' || chr(10) || '    return sqrt(' || v || ') * ' || n || ' + pi' ELSE '' END AS function_code,
CASE WHEN ok THEN '{"op":"Add","left":{"op":"Mult","left":{"call":"sqrt","args":[{"var":"' || v || '"}]},"right":{"const":' || n || '}},"right":{"var":"pi"}}' ELSE '' END AS ast_json,
CASE WHEN ok THEN '["' || v || '"]' ELSE '[]' END AS variables FROM x""",
    ),
    "eval_prf1": Query(
        lambda s, d: E.prf1(_domains(s, d).where("model = 'wide-reader'").select("document_type"), _domains(s, d).where("model = 'tiny-reader' AND type_confidence > 0.8").select("document_type"), ["document_type"]),
        f"""WITH {ROWS}, p AS (SELECT DISTINCT document_type AS k FROM c WHERE model = 'wide-reader'), g AS (SELECT DISTINCT document_type AS k FROM c WHERE model = 'tiny-reader' AND type_confidence > 0.8),
n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM p JOIN g ON p.k = g.k) AS b) SELECT b AS "both", round(b / np, 6) AS "precision", round(b / ng, 6) AS recall, round(2 * b / (np + ng), 6) AS f1 FROM n""",
    ),
    "eval_normalized_prf1": Query(
        lambda s, d: E.normalized_prf1(S.part_names(s, d), table(s, d, "part").where("p_size % 2 = 0").select(F.col("p_name").alias("name")), "name"),
        f"""WITH {S.NAMES}, p AS (SELECT DISTINCT {S.norm_sql('name')} AS k FROM names), g AS (SELECT DISTINCT {S.norm_sql('p_name')} AS k FROM part WHERE p_size % 2 = 0),
n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM p JOIN g ON p.k = g.k) AS b) SELECT b AS "both", round(b / np, 6) AS "precision", round(b / ng, 6) AS recall, round(2 * b / (np + ng), 6) AS f1 FROM n""",
    ),
    "eval_label_accuracy": Query(
        lambda s, d: E.accuracy(table(s, d, "artifacts").distinct(), "file_type", "scan_status").withColumn("n", F.col("n")),
        "SELECT count(*) AS n, round(avg((file_type IS NOT DISTINCT FROM scan_status)::INT), 6) AS accuracy FROM (SELECT DISTINCT * FROM artifacts)",
    ),
    "eval_contained": Query(
        lambda s, d: E.contained_share(table(s, d, "documents").where("text IS NOT NULL").select("text", F.lit("review").alias("part"))),
        "SELECT count(*) AS n, round(avg(contains(text, 'review')::INT), 6) AS share FROM documents WHERE text IS NOT NULL",
    ),
    "eval_reading_order": Query(
        lambda s, d: E.ordered_share(table(s, d, "documents").where("text IS NOT NULL").select("text", F.lit("the").alias("first"), F.lit("review").alias("second"))),
        "SELECT round(avg((instr(text, 'the') > 0 AND instr(text, 'review') > 0 AND instr(text, 'the') < instr(text, 'review'))::INT), 6) AS score FROM documents WHERE text IS NOT NULL",
    ),
}
