"""Names of the engine's own queries and their DuckDB oracles."""

from __future__ import annotations

from .plans.catalogue import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
