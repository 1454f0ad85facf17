"""Classified documents: domains out of JSON text, frequencies, canonical names, merges of partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import names
from lodestack.operators.resolution import similar_pairs

FLOOR, MAP, MERGE = 0.6, 0.90, 0.88


def clean_confidence(text: Column, default: float = 0.5) -> Column:
    """A number between 0 and 1; NaN, NULL and text that is no number give the default."""
    x = F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")
    x = F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def parsed_domains(json: Column) -> Column:
    """array<struct<domain, confidence>> of a JSON list of {domain, confidence} or plain strings (0.5); blank names are left out, text that is no JSON list gives NULL."""
    whole = F.when(F.try_parse_json(json).isNotNull() & F.trim(json).startswith("["), F.from_json(json, "array<string>"))
    one = lambda x: F.struct(
        F.trim(F.when(x.startswith("{"), F.get_json_object(x, "$.domain")).otherwise(x)).alias("domain"),
        F.when(x.startswith("{"), clean_confidence(F.get_json_object(x, "$.confidence"))).otherwise(F.lit(0.5)).alias("confidence"),
    )
    return F.filter(F.transform(F.filter(whole, lambda x: x.isNotNull()), one), lambda x: F.coalesce(x["domain"], F.lit("")) != "")


def exploded_domains(classifications: DataFrame) -> DataFrame:
    """artifact_id, position, domain, confidence."""
    return classifications.select("artifact_id", F.posexplode(parsed_domains(F.col("domains"))).alias("position", "d")).select("artifact_id", "position", "d.*")


def top_domains(exploded: DataFrame) -> DataFrame:
    """domain, documents (each once) and the mean confidence over all entries."""
    return exploded.groupBy("domain").agg(F.count_distinct("artifact_id").alias("documents"), F.round(F.avg("confidence"), 3).alias("average_confidence"))


def name_frequency(rows: DataFrame, name: str) -> DataFrame:
    """Spellings that differ in case only, together: least spelling, mentions, documents, mean confidence."""
    return rows.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("k")).agg(
        F.min(name).alias("name"), F.count("*").alias("mentions"), F.count_distinct("artifact_id").alias("documents"), F.round(F.avg("confidence"), 3).alias("average_confidence")
    ).drop("k")


def connecting(concepts: DataFrame, domains: DataFrame, least: int = 2) -> DataFrame:
    """Concepts (artifact_id, concept) whose documents span several domains (artifact_id, domain): the sorted domains."""
    j = concepts.join(domains, "artifact_id").groupBy("concept").agg(F.array_sort(F.collect_set("domain")).alias("d"))
    return j.where(F.size("d") >= least).select("concept", F.size("d").alias("n"), F.array_join("d", "; ").alias("domains"))


def canonical_map(found: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """domain and canonical: an alias or name of the taxonomy with the same normal form, else the most similar canonical name from MAP on (the last by name on ties), else NULL.

    Only distinct names are compared, and those by shared tokens, so no name meets every other.
    """
    known = taxonomy.select("domain", F.explode(F.concat(F.array("domain"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    known = known.select(names.normalize_name(F.col("alias")).alias("norm"), F.col("domain").alias("canonical")).where("norm <> ''").groupBy("norm").agg(F.max("canonical").alias("exact"))
    seen = found.select("domain").where("domain IS NOT NULL").distinct().withColumn("norm", names.normalize_name(F.col("domain")))
    near = similar_pairs(seen.select(F.col("domain").alias("name")), taxonomy.select(F.col("domain").alias("name")).distinct(), MAP)
    best = near.groupBy(F.col("a").alias("domain")).agg(F.max_by("b", F.struct("score", "b")).alias("similar"))
    return seen.join(known, "norm", "left").join(best, "domain", "left").select("domain", F.coalesce("exact", "similar").alias("canonical"))


def canonical_domains(exploded: DataFrame, mapped: DataFrame) -> DataFrame:
    """Per document the domains from FLOOR on under their canonical names (own name where there is none), best confidence each, in order of appearance."""
    kept = exploded.where(F.col("confidence") >= FLOOR).join(mapped, "domain", "left").withColumn("name", F.coalesce("canonical", "domain"))
    by = kept.groupBy("artifact_id", names.normalize_name(F.col("name")).alias("norm")).agg(F.min_by("name", "position").alias("domain"), F.max("confidence").alias("confidence"), F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("artifact_id").orderBy("position")) - 1
    return by.select("artifact_id", "domain", "confidence", rank.alias("rank"))


def fuzzily_merged(exploded: DataFrame) -> DataFrame:
    """artifact_id, domain, confidence, rank: within a document, in order of appearance, a domain joins the first one before it that is alike from MERGE on.

    The first spelling stays, with the best confidence. exploded: artifact_id, position, domain, confidence; a document's domains are the few of its classification.
    """
    n = exploded.where(F.coalesce("domain", F.lit("")) != "").withColumn("norm", names.normalize_name(F.col("domain")))
    n = n.withColumns({"tokens": names.key_tokens(F.col("norm")), "grams": names.trigrams(F.col("norm"))})
    lists = n.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("position", "domain", "confidence", "norm", "tokens", "grams"))).alias("all"))

    def alike(a: Column, b: Column) -> Column:
        return (a["norm"] == b["norm"]) | (F.round(names.similarity(a["norm"], b["norm"], a["tokens"], b["tokens"], a["grams"], b["grams"]), 9) >= MERGE)

    def join(had: Column, x: Column) -> Column:
        at = F.array_position(F.transform(had, lambda h: alike(h, x)), True)
        surer = lambda h, i: F.when(i + 1 == at, h.withField("confidence", F.greatest(h["confidence"], x["confidence"]))).otherwise(h)
        return F.when(at > 0, F.transform(had, surer)).otherwise(F.concat(had, F.array(x)))

    kept = lists.select("artifact_id", F.aggregate("all", F.slice("all", 1, 0), join).alias("kept"))
    return kept.select("artifact_id", F.posexplode("kept").alias("rank", "x")).select("artifact_id", "x.domain", "x.confidence", "rank")


def merged(parts: DataFrame) -> DataFrame:
    """One row per document out of its partial classifications: the fields of the most certain part (the largest id on ties) and the number of parts."""
    surest = F.max_by(F.struct("document_type", "type_confidence", "short_summary", "model"), F.struct("type_confidence", "id"))
    return parts.groupBy("artifact_id").agg(surest.alias("x"), F.count("*").alias("parts")).select("artifact_id", "x.*", "parts")
