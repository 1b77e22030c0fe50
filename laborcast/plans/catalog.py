"""The registry of named queries and their SQL equivalents."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .lenses import with_lenses

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def decimal_round(value: str, digits: int) -> str:
    """DuckDB text that rounds a double by its shortest decimal form, as Spark does."""
    return f"CAST(round(CAST(CAST(({value})::DOUBLE AS VARCHAR) AS DECIMAL(38,17)), {digits}) AS DOUBLE)"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent over the same lenses, run by DuckDB."""
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_lenses(sql, "duckdb")
        return fn

    return register
