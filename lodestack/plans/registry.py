"""The queries by name. Each has a function of (session, folder of the tables) and, where SQL can say it, its statement."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that hold QUERIES.
MODULES = ["links", "catalog", "resolution", "semantic", "responses", "compliance", "graph", "history", "knowledge", "retrieval", "derived", "streams"]


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def core() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        out |= importlib.import_module(f"lodestack.plans.{name}").QUERIES
    return out
