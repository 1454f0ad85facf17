"""A query and its SQL side by side on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd

FOLDER = "/root/testdata/sf0.001"


def views():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        return plain(v.item())
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).values.tolist())


def same(spark, con, query):
    ours = query.run(spark, FOLDER).toPandas()
    if query.sql is None:
        return ours is not None
    left, right = table(ours), table(con.sql(query.sql).df())
    assert left[0] == right[0]
    assert left[1] == right[1]
    return True
