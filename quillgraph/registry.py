"""Registry of the engine's own queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query, and its oracle if SQL can express it."""

    def add(fn: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    import importlib
    import pkgutil

    from quillgraph import plans

    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"quillgraph.plans.{m.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
