"""Registry of the text queries; the same kind of record as in the rest of the library."""

from __future__ import annotations

from tickloom.plans.registry import Query, Tables

QUERIES: dict[str, Query] = {}

__all__ = ["QUERIES", "Tables", "query"]


def query(name: str, covers: str, sql: str | None = None):
    def add(plan):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, tuple(covers.split()), plan, sql)
        return plan

    return add
