"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the inventory entries that it covers and its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = tuple(covers.split())
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from meridia.plans import (  # noqa: F401
        audit_queries,
        calendar_queries,
        cell_queries,
        event_queries,
        grid_queries,
        join_queries,
        pick_queries,
        route_queries,
        source_queries,
        step_queries,
        text_queries,
        triple_queries,
    )
