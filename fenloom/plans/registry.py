from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can state it, the SQL that must agree."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def with_(*parts: str, body: str) -> str:
    """One SQL text from named sub-queries and a final SELECT."""
    return "WITH " + ",\n".join(parts) + "\n" + body


def rnd(expr: str, digits: int = 6) -> str:
    """SQL rounding that matches ``roles.r6`` (no negative zero)."""
    return f"(round({expr}, {digits}) + CAST(0 AS DOUBLE))"
