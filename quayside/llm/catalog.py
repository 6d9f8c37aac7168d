"""Registry of the training-text queries and their checking SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function as query ``name``, with the SQL that must give the same rows."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load():
    """Import the query modules of this subpackage once, so that they register."""
    import quayside.llm as package

    for info in pkgutil.iter_modules(package.__path__):
        if info.name.startswith("query_"):
            importlib.import_module(f"{package.__name__}.{info.name}")
    return QUERIES, ORACLES
