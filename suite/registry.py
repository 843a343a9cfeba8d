"""All registered queries, by the identifiers of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name with the SQL statement that must give the same rows."""

    def keep(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"registered twice: {name}")
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return keep


def _load() -> None:
    import importlib

    for module in ("sources", "projections", "joins", "profiles", "ordering", "time", "functions", "decision", "scoring"):
        importlib.import_module(f"suite.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(sorted(_QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(_SQL.items()))
