"""Named checks: a Spark query and, where SQL can say it, the same thing as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        key = name or query.__name__
        if key in QUERIES:
            raise ValueError(f"two checks named {key}")
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return add
