"""The registry of queries and of the DuckDB statements that must equal them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The point in time that stands for "now" in the queries.
NOW = "2026-04-01 00:00:00"
NOW_SQL = f"TIMESTAMPTZ '{NOW}+00'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its twin in SQL if it has one."""

    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def sql_list(words) -> str:
    """Words as the inside of an IN list."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
