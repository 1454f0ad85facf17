"""Measures of texts: how hard a document is, what it refers to, and scores from several factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of formulas, and terms of normative texts.
FORMULA = r"\\frac|\\sum|\\sqrt|\\int|\$\$|\\\[|\\\(|\^\{|_\{|≤|≥|≈|∑|√|∫|×"
NORMATIVE = ["shall ", "must not", " iso ", " iec ", "gdpr", "nis2", "article ", "clause ", "regulation", "directive", "eurocode", "annex ", "obligation", "compliance"]
LONG_CHARS = 60_000


def occurrences(text: Column, part: str) -> Column:
    """How often a part occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def profiled(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, length, share of symbols, formula marks, normative terms, their blend, and whether the deep model is due. NULL is ''.

    In steps, so that each measure is worked out once.
    """
    a = df.select(key, F.coalesce(text, F.lit("")).alias("body"))
    a = a.select(key, "body", F.lower("body").alias("low"), F.regexp_replace("body", r"(?U)\s+", "").alias("solid"))
    symbols = F.length(F.regexp_replace("solid", r"[\p{L}\p{N}]+", ""))
    terms = sum((occurrences(F.col("low"), t) for t in NORMATIVE[1:]), occurrences(F.col("low"), NORMATIVE[0]))
    a = a.select(
        key, F.length("body").alias("char_count"), F.coalesce(F.try_divide(symbols, F.length("solid")), F.lit(0.0)).alias("ratio"), F.regexp_count("body", F.lit(FORMULA)).alias("equation_hits"), terms.alias("standard_hits")
    )
    one = F.lit(1.0)
    score = 0.35 * F.least(one, F.col("char_count") / LONG_CHARS) + 0.20 * F.least(one, F.col("ratio") / 0.30) + 0.25 * F.least(one, F.col("equation_hits") / 5.0) + 0.20 * F.least(one, F.col("standard_hits") / 8.0)
    deep = (F.col("equation_hits") >= 2) | (F.col("standard_hits") >= 4)
    return a.select(key, "char_count", F.round("ratio", 4).alias("symbol_ratio"), "equation_hits", "standard_hits", F.round(F.least(one, score), 4).alias("score"), deep.alias("forces_deep"))


def saturated(value: Column, target: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / target))


def confidence(mean: Column, documents: Column, mentions: Column, consistency: Column, rejected: Column | None = None, approved: Column | None = None) -> Column:
    """Support of an object from the mean of its mentions, their number, the number of documents and the share of links kept.

    A rejection by a reviewer leaves two fifths of it, else an approval adds .05.
    """
    base = 0.45 * mean + 0.25 * saturated(documents, 8) + 0.15 * saturated(mentions, 12) + 0.15 * consistency
    no = F.lit(False)
    base = F.when(no if rejected is None else F.coalesce(rejected, no), base * 0.4).when(no if approved is None else F.coalesce(approved, no), base + 0.05).otherwise(base)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 3)


def cut_to_chunks(text: Column, size: int, overlap: int) -> Column:
    """Chunks of a fixed size and stride; one chunk when the text fits. Array of struct(n, chunk)."""
    body = F.coalesce(text, F.lit(""))
    step = max(1, size - max(0, overlap))
    starts = F.when(F.length(body) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(body) - 1, F.lit(step)))
    return F.transform(starts, lambda s, n: F.struct(n.alias("n"), F.substring(body, s + 1, size).alias("chunk")))


def page_needs_vision(text: Column, has_visuals: Column) -> Column:
    """A formula's mark, or visuals and less than 200 characters."""
    return text.rlike(FORMULA) | (has_visuals & (F.length(F.trim(text)) < 200))


def designation(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def mentions(text: Column, name: Column) -> Column:
    """Whether a designation stands in the text as a whole."""
    d = designation(name)
    safe = F.regexp_replace(d, r"([^\p{L}\p{N}\s])", r"\\$1")
    return (d != "") & F.rlike(designation(text), F.concat(F.lit(r"(?U)(?<![\w-])"), safe, F.lit(r"(?![\w-])")))
