"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` computes the same rows by itself."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register
