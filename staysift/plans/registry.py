"""Registry of the queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that gives the same rows where there is one."""

    def add(build: Query) -> Query:
        QUERIES[name] = build
        if check:
            CHECKS[name] = check.strip()
        return build

    return add
