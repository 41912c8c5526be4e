"""All queries of the spatial engine and their SQL twins, by name."""

from __future__ import annotations

from lidarlake.plans import MODULES


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
