"""Catalogues of standards: a mapping (JSON, or YAML where a parser is installed) or a CSV file of requirements."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["standard_name", "clause_ref", "title", "text", "obligation_level"]
#: Confidence of curated rows.
CURATED = 0.95


def load(spark: SparkSession, path: str) -> DataFrame:
    """standard_name, clause_ref, title, text, obligation_level, confidence. Another ending raises ValueError. A catalogue is written by hand, so the driver reads it."""
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        df = spark.read.csv(path, header=True)
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in COLUMNS], F.lit(CURATED).alias("confidence"))
    if suffix == ".json":
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    elif suffix in (".yml", ".yaml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML needs a parser that isn't installed") from e
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    else:
        raise ValueError(f"no catalogue: {path}")
    name = (raw.get("standard") or {}).get("name")
    rows = [(name, *[None if r.get(c) is None else str(r[c]) for c in COLUMNS[1:]], CURATED) for r in raw.get("requirements") or []]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS) + ", confidence double")


def replace_standard(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """The stored rows with those of the loaded standards put in the place of their old ones."""
    return stored.join(loaded.select("standard_name").distinct(), "standard_name", "left_anti").unionByName(loaded)
