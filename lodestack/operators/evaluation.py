"""Measures of results against what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.names import normalize_name


def prf1(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision, recall, F1 of two sets of keys. Two empty sets agree (1); one empty side gives 0."""
    p, g = predicted.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    c = p.join(g, keys, "full").agg(F.count("p").alias("p"), F.count("g").alias("g"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("both"))
    none = (F.col("p") == 0) & (F.col("g") == 0)
    share = lambda n: F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(F.col("both"), F.col(n)), F.lit(0.0)))
    f1 = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(2 * F.col("both"), F.col("p") + F.col("g")), F.lit(0.0)))
    return c.select("both", F.round(share("p"), 6).alias("precision"), F.round(share("g"), 6).alias("recall"), F.round(f1, 6).alias("f1"))


def normalized_prf1(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """prf1 of names by their normal forms; NULL and names without one count as none."""
    form = lambda df: df.select(normalize_name(F.col(key)).alias(key)).where(F.col(key) != "")
    return prf1(form(predicted), form(gold), [key])


def accuracy(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows whose columns agree; 1 without rows."""
    return pairs.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("int")), F.lit(1.0)), 6).alias("accuracy"))


def ordered_share(pairs: DataFrame) -> DataFrame:
    """Of rows (text, first, second): the share in which both parts occur and the first comes first; 1 without rows."""
    a, b = F.expr("instr(text, first)"), F.expr("instr(text, second)")
    return pairs.agg(F.round(F.coalesce(F.avg(((a > 0) & (b > 0) & (a < b)).cast("int")), F.lit(1.0)), 6).alias("score"))


def contained_share(pairs: DataFrame) -> DataFrame:
    """Of rows (text, part): the share in which the text holds the part; 1 without rows."""
    return pairs.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.contains("text", "part").cast("int")), F.lit(1.0)), 6).alias("share"))
