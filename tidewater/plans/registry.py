"""Where the plan modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans.bindings import cte

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query, and its DuckDB SQL where SQL can express it; ``uses`` names the canonical tables of the SQL.

    ``sql`` is a SELECT, or further WITH entries and a SELECT separated by a line ``---``.
    """

    def put(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            head, _, tail = sql.rpartition("\n---\n")
            parts = [p for p in (cte(*uses) if uses else "", head.strip()) if p]
            ORACLES[name] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + tail.strip()
        return function

    return put
