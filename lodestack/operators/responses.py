"""Answers of a model about a document, as text, into rows: the JSON object in the answer and its lists, by tables of fields.

Everything is built of Spark's JSON functions. Lists that are none, and entries without what they need, are left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import names
from lodestack.operators.semantic import clean_confidence

# What answers may name, and the names under which they may give a field.
DOCUMENT_TYPES = ["Governance", "Strategy", "Architecture", "Roadmap", "Project", "Meeting Notes", "Workshop", "Presentation", "Budget", "Report", "Requirements", "Technical Design", "Operating Model", "Training", "Standard", "Regulation", "Source Code", "Other"]
ENTITY_TYPES = ["Capability", "Initiative", "Team", "Product", "Platform", "Process", "Technology", "Concept", "Decision", "Risk", "Standard", "Requirement", "Equation", "Module", "Class", "Function", "Library", "Service", "Interface", "API"]
PREDICATES = ["supports", "depends_on", "implements", "mentions", "references", "affects", "owned_by", "related_to", "mandated_by", "satisfies", "specifies", "supersedes", "imports", "calls", "extends", "exposes", "defines"]
OBLIGATIONS = ["MANDATORY", "RECOMMENDED", "OPTIONAL"]


class Shape(NamedTuple):
    """fields: output field -> names in the answer, the first filled one counts. needs: one of each of these groups must be filled.
    plain: the field that an entry which is just a text gives. listed: fields that must be of a list, and what stands for others (None: the entry goes).
    title: the field whose leading clause names an entry without a title. key: fields that tell entries apart when results are merged.
    """

    fields: dict[str, tuple[str, ...]]
    needs: tuple[tuple[str, ...], ...]
    key: tuple[str, ...]
    plain: str | None = None
    listed: dict[str, tuple[list[str], str | None]] = {}
    title: str | None = None


_QUOTE = {"supporting_text": ("supporting_text",)}
_STANDARD = {"standard_name": ("standard_name", "standard"), "standard_version": ("standard_version", "version")}
_CLAUSE = ("clause_ref", "clause", "ref")
SHAPES = {
    "domains": Shape({"domain": ("domain", "name")}, (("domain",),), ("domain",), "domain"),
    "capabilities": Shape({"name": ("name", "capability")} | _QUOTE, (("name",),), ("name",), "name"),
    "entities": Shape({"entity_type": ("entity_type",), "name": ("name",)} | _QUOTE, (("name",),), ("entity_type", "name"), listed={"entity_type": (ENTITY_TYPES, "Concept")}),
    "decisions": Shape({"decision_text": ("decision_text", "decision", "text"), "title": ("title",)} | _QUOTE, (("decision_text",),), ("title",), "decision_text", title="decision_text"),
    "risks": Shape({"risk_description": ("risk_description", "risk", "text"), "title": ("title",)} | _QUOTE, (("risk_description",),), ("title",), "risk_description", title="risk_description"),
    "relationships": Shape({"subject": ("subject", "source"), "predicate": ("predicate",), "object": ("object", "target")} | _QUOTE, (("subject",), ("object",)), ("subject", "predicate", "object"), listed={"predicate": (PREDICATES, None)}),
    "requirements": Shape({"clause_ref": _CLAUSE, "title": ("title", "name"), "text": ("text", "requirement_text"), "obligation_level": ("obligation_level",)} | _STANDARD | _QUOTE, (("text", "clause_ref", "title"),), ("standard_name", "clause_ref"), listed={"obligation_level": (OBLIGATIONS, "MANDATORY")}),
    "equations": Shape(
        {"clause_ref": _CLAUSE, "symbol": ("symbol", "result", "name"), "title": ("title",), "expression": ("expression", "formula"), "python_code": ("python_code", "python"), "latex": ("latex", "notation")} | _STANDARD | _QUOTE,
        (("expression", "python_code", "symbol", "clause_ref"),), ("standard_name", "clause_ref", "symbol"),
    ),
}


def json_object(answer: Column) -> Column:
    """The JSON object of an answer: the whole, what a code fence holds, or what lies between its first and last brace. NULL without one."""
    text = F.trim(answer)
    fenced = F.trim(F.regexp_extract(text, r"(?s)```(?:\w+)?\s*(.*?)```", 1))
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    is_object = lambda x: F.when(x.startswith("{") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(is_object(text), is_object(fenced), is_object(braced))


def _text(item: Column, name: str) -> Column:
    return F.trim(F.get_json_object(item, f"$.{name}"))


def _filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _chosen(value: Column, listed: list[str], otherwise: str | None) -> Column:
    """The listed spelling of a value, in any case."""
    known = F.create_map(*[F.lit(x) for v in listed for x in (v.lower(), v)])
    return F.coalesce(F.try_element_at(known, F.lower(value)), F.lit(otherwise))


def _entry(item: Column, shape: Shape) -> Column:
    is_object = item.startswith("{")
    out = {}
    for field, given in shape.fields.items():
        value = F.coalesce(*[F.nullif(_text(item, n), F.lit("")) for n in given], F.lit(""))
        out[field] = F.when(is_object, value).otherwise(F.trim(item) if field == shape.plain else F.lit(""))
    for field, (listed, otherwise) in shape.listed.items():
        out[field] = _chosen(out[field], listed, otherwise)
    if shape.title:
        out["title"] = F.when(_filled(out["title"]), out["title"]).otherwise(names.derived_title(out[shape.title]))
    given = F.get_json_object(item, "$.confidence")
    return F.struct(*[v.alias(k) for k, v in out.items()], F.when(is_object, clean_confidence(given)).otherwise(F.lit(0.5)).alias("confidence"))


def parsed(answer: Column, name: str) -> Column:
    """The entries of one of the SHAPES in an answer, as an array of structs; empty without a list."""
    shape = SHAPES[name]
    value = F.get_json_object(answer, f"$.{name}")
    items = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    items = F.filter(items, lambda x: x.isNotNull() & (x.startswith("{") | (F.lit(shape.plain is not None) & ~x.startswith("["))))
    entries = F.transform(items, lambda x: _entry(x, shape))
    must = [field for field, (_, otherwise) in shape.listed.items() if otherwise is None]

    def whole(e: Column) -> Column:
        out = F.lit(True)
        for group in (*shape.needs, *((f,) for f in must)):
            out = out & F.array_contains(F.array(*[_filled(e[f]) for f in group]), True)
        return out

    entries = F.filter(entries, whole)
    return F.coalesce(entries, F.filter(F.array(_entry(F.lit("{}"), shape)), lambda e: F.lit(False)))


def document_fields(answer: Column) -> Column:
    """document_type (a listed one or Other), type_confidence (0 to 1, 0.5 when none is given) and the two summaries."""
    text = lambda n: F.coalesce(_text(answer, n), F.lit(""))
    return F.struct(_chosen(text("document_type"), DOCUMENT_TYPES, "Other").alias("document_type"), clean_confidence(F.get_json_object(answer, "$.type_confidence")).alias("type_confidence"), text("short_summary").alias("short_summary"), text("long_summary").alias("long_summary"))


def parsed_answers(answers: DataFrame, key: str = "artifact_id", answer: str = "answer") -> DataFrame:
    """key, ok (whether there is an object), the document's fields and one array column for each of the SHAPES. Other columns are not read."""
    found = answers.select(key, json_object(F.col(answer)).alias("j"))
    return found.select(key, F.col("j").isNotNull().alias("ok"), document_fields(F.col("j")).alias("d"), *[parsed(F.col("j"), n).alias(n) for n in SHAPES]).select(key, "ok", "d.*", *SHAPES)


def rows_of(parsed_: DataFrame, name: str, key: str = "artifact_id") -> DataFrame:
    """key, position and the fields of one list's entries."""
    return parsed_.select(key, F.posexplode(name).alias("position", "e")).select(key, "position", "e.*")


def deduped(rows: DataFrame, name: str, key: str = "artifact_id") -> DataFrame:
    """Of a document's entries alike in their key fields (in any case) the most certain, the first of those; in the order in which each kind first came."""
    same = [F.lower(F.col(f)).alias(f"k{i}") for i, f in enumerate(SHAPES[name].key)]
    fields = [c for c in rows.columns if c not in (key, "position")]
    by = rows.groupBy(key, *same).agg(F.max_by(F.struct(*fields), F.struct("confidence", -F.col("position"))).alias("e"), F.min("position").alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1
    return by.select(key, place.alias("position"), "e.*")
