"""Registry of the library's own queries and their SQL equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "chronology_earliest"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query function under ``name``, with its DuckDB SQL if it has one."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if sql:
            _SQL[name] = sql
        return query

    return add


def _load() -> None:
    """Import the modules that register queries."""
    for name in ("corpus", "vault", "maintenance", "observation", "retrieval", "activation", "threads", "script", "plans", "exchange"):
        importlib.import_module(f"quillstrata.queries.{name}")


def queries() -> dict[str, Query]:
    """Return every registered query."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Return the SQL of the queries that SQL can express."""
    _load()
    return dict(_SQL)
