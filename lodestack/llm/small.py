"""Small control tables (profiles, jobs) as driver-side rows, behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

#: More control rows than this are a mistake: they are parameters, not data.
MOST_ROWS = 10_000


def control_rows(df: DataFrame) -> list[Row]:
    rows = df.distinct().limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a control table has more than {MOST_ROWS} rows")
    return rows
