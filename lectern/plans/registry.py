"""The registered queries: a DataFrame plan and, where SQL can express it, the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under `name`; `sql` is its oracle."""

    def add(query: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = query
        if sql:
            _oracles[name] = sql
        return query

    return add


def _load() -> None:
    """Importing a module of queries registers them."""
    from lectern.plans import corpus_queries, evaluation_queries, event_queries, review_queries, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
