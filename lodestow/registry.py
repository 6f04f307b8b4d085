"""All registered queries of the library, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the DuckDB SQL of the same rows where SQL can express them."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are called {name}")
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return add


def load() -> None:
    """Import the modules that register queries."""
    from .queries import binaries, catalog, containers, flows, matching, ordered, patches, plans, streams, texts  # noqa: F401


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge flow: grouping, ranking, picking and looking up in one plan."""
    return queries()["merge_plan"](spark, sf_dir)
