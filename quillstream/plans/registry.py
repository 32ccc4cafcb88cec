"""Every registered query with the SQL that a second engine answers it with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    from . import catalog_queries, classification_queries, discovery_queries, export_queries, intake_queries, item_queries, list_queries, mutation_queries, pack_queries, run_queries, scalar_queries, scan_queries, source_queries, state_queries, store_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
