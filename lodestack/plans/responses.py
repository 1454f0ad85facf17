"""Queries over a model's answers. The answers are made of part rows in several wrappings; the SQL says what they hold without parsing them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import formulas
from lodestack.operators import responses as P
from lodestack.plans.registry import Query
from lodestack.runtime import table


def answers(spark, d):  # noqa: ANN001, ANN202
    """artifact_id and answer: a JSON object by itself, in a code fence, between words, or none."""
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    text = lambda c: F.to_json(F.array(c))
    quoted = lambda c: F.substring(text(c), F.lit(2), F.length(text(c)) - 2)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("report", "MEETING NOTES", "Budget", "nonsense")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    body = F.concat(
        F.lit('{"document_type": '), quoted(kind), F.lit(', "type_confidence": "0.'), F.lpad(size, 2, "0"), F.lit('", "short_summary": '), quoted(name),
        F.lit(', "domains": [{"domain": '), quoted(brand), F.lit(', "confidence": 0.'), F.lpad(size, 2, "0"), F.lit("}, "), quoted(F.concat(F.lit(" "), F.col("p_type"))), F.lit(', 7, [], {"confidence": 1}]'),
        F.lit(', "capabilities": [{"capability": '), quoted(name), F.lit(', "confidence": "0.9", "supporting_text": '), quoted(brand), F.lit('}, {"name": "  "}]'),
        F.lit(', "entities": [{"entity_type": "PLATFORM", "name": '), quoted(name), F.lit(', "confidence": 2}, {"entity_type": "gadget", "name": '), quoted(brand), F.lit('}, {"entity_type": "Team"}, "text"]'),
        F.lit(', "decisions": ['), quoted(F.concat(F.lit("Adopt "), name, F.lit("; then stop"))), F.lit(', {"text": '), quoted(name), F.lit(', "title": "T"}]'),
        F.lit(', "risks": [{"risk": '), quoted(F.concat(F.lit("Loss of "), name, F.lit(". More"))), F.lit(', "confidence": 0.25}]'),
        F.lit(', "relationships": [{"source": '), quoted(name), F.lit(', "predicate": "DEPENDS_ON", "target": '), quoted(brand), F.lit(', "confidence": 0.7}, {"source": "a", "predicate": "likes", "target": "b"}]'),
        F.lit(', "requirements": [{"ref": "4.'), size, F.lit('", "standard": '), quoted(brand), F.lit(', "obligation_level": "recommended"}, {"standard": "empty"}]'),
        F.lit(', "equations": [{"formula": "a*'), size, F.lit('", "symbol": "V_'), size, F.lit('", "clause": "1.2"}, {"formula": "a.b"}]}'),
    )
    k = F.col("p_partkey")
    wrapped = F.when(k % 17 == 0, "no object here").when(k % 3 == 0, body).when(k % 3 == 1, F.concat(F.lit("Result:\n```json\n"), body, F.lit("\n```\n"))).otherwise(F.concat(F.lit("Sure. "), body, F.lit(" Hope it helps.")))
    return table(spark, d, "part").select(k.alias("artifact_id"), wrapped.alias("answer"))


def _rows(name, sql, *columns):  # noqa: ANN001, ANN202
    return Query(lambda s, d: P.rows_of(P.parsed_answers(answers(s, d)), name).select("artifact_id", "position", *columns, "confidence"), f"WITH p AS (SELECT p_partkey AS artifact_id, * FROM part WHERE p_partkey % 17 <> 0) {sql}")


def _equations(spark, d):  # noqa: ANN001, ANN202
    rows = P.rows_of(P.parsed_answers(answers(spark, d)), "equations").withColumn("key", F.concat_ws("/", "artifact_id", "position"))
    return formulas.formulas(rows, "key", "expression", "symbol", "python_code").select("key", "valid", "variables")


def _deduped(spark, d):  # noqa: ANN001, ANN202
    """A part's entities said twice, the second time less surely and in capitals."""
    once = P.rows_of(P.parsed_answers(answers(spark, d)), "entities")
    again = once.withColumns({"name": F.upper("name"), "confidence": F.col("confidence") / 2, "position": F.col("position") + 10})
    return P.deduped(once.unionByName(again), "entities").select("artifact_id", "position", "entity_type", "name", "confidence")


QUERIES = {
    "parse_documents": Query(
        lambda s, d: P.parsed_answers(answers(s, d)).select("artifact_id", "ok", "document_type", "type_confidence", "short_summary"),
        """SELECT p_partkey AS artifact_id, p_partkey % 17 <> 0 AS ok, CASE WHEN p_partkey % 17 = 0 THEN 'Other' ELSE ['Report', 'Meeting Notes', 'Budget', 'Other'][p_partkey % 4 + 1] END AS document_type,
CASE WHEN p_partkey % 17 = 0 THEN 0.5::DOUBLE ELSE p_size / 100.0::DOUBLE END AS type_confidence, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS short_summary FROM part""",
    ),
    "parse_domains": _rows("domains", "SELECT artifact_id, 0 AS position, p_brand AS domain, p_size / 100.0::DOUBLE AS confidence FROM p UNION ALL SELECT artifact_id, 1, p_type, 0.5 FROM p UNION ALL SELECT artifact_id, 2, '7', 0.5 FROM p", "domain"),
    "parse_capabilities": _rows("capabilities", "SELECT artifact_id, 0 AS position, p_name AS name, p_brand AS supporting_text, 0.9::DOUBLE AS confidence FROM p", "name", "supporting_text"),
    "parse_entities": _rows("entities", "SELECT artifact_id, 0 AS position, 'Platform' AS entity_type, p_name AS name, 1.0::DOUBLE AS confidence FROM p UNION ALL SELECT artifact_id, 1, 'Concept', p_brand, 0.5 FROM p", "entity_type", "name"),
    "parse_decisions": _rows(
        "decisions", "SELECT artifact_id, 0 AS position, 'Adopt ' || p_name || '; then stop' AS decision_text, 'Adopt ' || p_name AS title, 0.5::DOUBLE AS confidence FROM p UNION ALL SELECT artifact_id, 1, p_name, 'T', 0.5 FROM p", "decision_text", "title"
    ),
    "parse_risks": _rows("risks", "SELECT artifact_id, 0 AS position, 'Loss of ' || p_name || '. More' AS risk_description, 'Loss of ' || p_name AS title, 0.25::DOUBLE AS confidence FROM p", "risk_description", "title"),
    "parse_relationships": _rows("relationships", "SELECT artifact_id, 0 AS position, p_name AS subject, 'depends_on' AS predicate, p_brand AS object, 0.7::DOUBLE AS confidence FROM p", "subject", "predicate", "object"),
    "parse_requirements": _rows("requirements", "SELECT artifact_id, 0 AS position, '4.' || p_size AS clause_ref, p_brand AS standard_name, 'RECOMMENDED' AS obligation_level, 0.5::DOUBLE AS confidence FROM p", "clause_ref", "standard_name", "obligation_level"),
    "parse_equations": Query(_equations, """WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 17 <> 0) SELECT k || '/0' AS key, true AS valid, '["a"]' AS variables FROM p UNION ALL SELECT k || '/1', false, '[]' FROM p"""),
    "parse_deduped": Query(
        _deduped,
        "WITH p AS (SELECT p_partkey AS artifact_id, * FROM part WHERE p_partkey % 17 <> 0) SELECT artifact_id, 0 AS position, 'Platform' AS entity_type, p_name AS name, 1.0::DOUBLE AS confidence FROM p UNION ALL SELECT artifact_id, 1, 'Concept', p_brand, 0.5 FROM p",
    ),
}
