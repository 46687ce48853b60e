"""The registry that the query modules fill."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) under a name, with its DuckDB counterpart."""

    def take(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return take
