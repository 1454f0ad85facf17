"""Formulas: whether they hold arithmetic and known functions only, their free names, and their structure. Nothing is ever run."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions and constants a formula may use, the operators it may hold, and the form of its structure (key: part).
FUNCTIONS = frozenset(
    ["abs", "min", "max", "round", "pow", "sum", "sqrt", "exp", "log", "log10", "log2", "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sinh", "cosh", "tanh", "hypot", "floor", "ceil", "degrees", "radians"]
)
CONSTANTS = frozenset(["pi", "e", "tau", "inf"])
OPERATORS = frozenset(["Add", "Sub", "Mult", "Div", "FloorDiv", "Mod", "Pow", "USub", "UAdd", "Not", "And", "Or", "Lt", "LtE", "Gt", "GtE", "Eq", "NotEq"])
STRUCTURE = {
    "Constant": {"const": "value"},
    "Name": {"var": "id"},
    "BinOp": {"op": "op", "left": "left", "right": "right"},
    "UnaryOp": {"unary": "op", "operand": "operand"},
    "BoolOp": {"bool": "op", "values": "values"},
    "Compare": {"compare": "left", "ops": "ops", "comparators": "comparators"},
    "IfExp": {"if": "test", "then": "body", "else": "orelse"},
    "Call": {"call": "func", "args": "args"},
}


class Formula(NamedTuple):
    valid: bool
    expression: str = ""
    function_code: str = ""
    ast_json: str = ""
    variables: tuple[str, ...] = ()
    note: str = ""


class _Refused(Exception):
    pass


def _structure(part: object, names: set[str]) -> object:
    """A part of a formula by the table STRUCTURE; its free names go to the set. Whatever the tables don't list is refused."""
    kind = type(part).__name__
    if isinstance(part, list):
        return [_structure(x, names) for x in part]
    if isinstance(part, (ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
        if kind not in OPERATORS:
            raise _Refused(f"operator {kind} is not allowed")
        return kind
    if not isinstance(part, ast.AST):
        return part
    if kind not in STRUCTURE:
        raise _Refused(f"{kind} is not allowed")
    if isinstance(part, ast.Name):
        names.add(part.id)
    if isinstance(part, ast.Call):
        if not isinstance(part.func, ast.Name) or part.func.id not in FUNCTIONS:
            raise _Refused("only calls of known functions are allowed")
        if part.keywords:
            raise _Refused("keyword arguments are not allowed")
        return {"call": part.func.id, "args": _structure(part.args, names)}
    return {key: _structure(getattr(part, name), names) for key, name in STRUCTURE[kind].items()}


def identifier(symbol: str | None) -> str:
    """A symbol as a name of code; '' when nothing is left."""
    name = re.sub(r"[^0-9a-zA-Z_]+", "_", (symbol or "").strip()).strip("_")
    return f"_{name}" if name[:1].isdigit() else name


def _returned(code: str) -> str:
    """The expression that a function's code returns first."""
    try:
        found = next((n.value for n in ast.walk(ast.parse(code)) if isinstance(n, ast.Return) and n.value is not None), None)
    except (SyntaxError, ValueError, RecursionError):
        return ""
    return ast.unparse(found) if found is not None else ""


def analyse(expression: str | None, symbol: str | None = None, code: str | None = None) -> Formula:
    """A formula's function form, structure and free names (sorted). Without an expression the code's returned one is taken. Invalid ones keep a note."""
    text = (expression or "").strip() or _returned((code or "").strip()).strip()
    if not text:
        return Formula(False, note="no expression")
    names: set[str] = set()
    try:
        structure = _structure(ast.parse(text, mode="eval").body, names)
        encoded = json.dumps(structure, separators=(",", ":"))
    except _Refused as why:
        return Formula(False, text, note=str(why))
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError) as why:
        return Formula(False, text, note=f"not an expression: {type(why).__name__}")
    free = tuple(sorted(names - CONSTANTS - FUNCTIONS))
    return Formula(True, text, f"def {identifier(symbol) or 'evaluate'}({', '.join(free)}):\n    return {text}", encoded, free)


def formulas(df: DataFrame, key: str, column: str, symbol: str | None = None, code: str | None = None) -> DataFrame:
    """key, valid, expression, function_code, ast_json, variables (JSON list) and note of each row's formula. NULL is no formula."""
    none = F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("x"), (F.col(symbol) if symbol else none).alias("s"), (F.col(code) if code else none).alias("c"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [analyse(*(v if isinstance(v, str) else None for v in r)) for r in zip(f.x, f.s, f.c, strict=True)]
            out = pd.DataFrame(found, columns=Formula._fields)
            yield out.assign(key=f.key.to_numpy(), variables=[json.dumps(x.variables) for x in found])[["key", "valid", "expression", "function_code", "ast_json", "variables", "note"]]

    kind = dict(rows.dtypes)["key"]
    return rows.mapInPandas(run, f"key {kind}, valid boolean, expression string, function_code string, ast_json string, variables string, note string").withColumnRenamed("key", key)


def to_identifier(symbol: Column) -> Column:
    """`identifier` as a column."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(symbol, F.lit(""))), "[^0-9a-zA-Z_]+", "_"), "^_+|_+$", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)
