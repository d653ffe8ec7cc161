"""Named queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB form."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    from . import plans

    plans.load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import plans

    plans.load()
    return dict(_SQL)
