"""Files of a folder tree as rows."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.names import content_id


def documents(spark: SparkSession, root: str, extensions: list[str], exclude: list[str] | None = None) -> DataFrame:
    """path, size, modified_at, sha256, id of the files with one of the endings, but those a glob excludes by whole path or name.

    Hashing happens where the file is read; content goes no further.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    kept = files.withColumn("path", path).where(F.lower("path").rlike(r"\.(" + "|".join(e.lstrip(".").lower() for e in extensions) + ")$"))
    for glob in exclude or []:
        rule = fnmatch.translate(glob).replace("(?s:", "(?s)(?:").replace(r"\Z", "$").replace(r"\z", "$")
        kept = kept.where(~F.col("path").rlike("^" + rule) & ~F.regexp_extract("path", "[^/]*$", 0).rlike("^" + rule))
    sha = F.sha2("content", 256)
    return kept.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), sha.alias("sha256"), content_id(sha).alias("id"))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """path and text of plain text and Markdown files, whole."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root)
    return t.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("value").alias("text"))
