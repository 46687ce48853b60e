"""Registry of the engine's queries and of their DuckDB counterparts."""

from __future__ import annotations

from .queries import construct, names, navigate, scan, strings, tables, variation  # noqa: F401
from .queries.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
