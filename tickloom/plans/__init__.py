"""Query plans over the input tables, grouped by topic."""

from __future__ import annotations

import importlib

MODULES = ["recordings", "lookups", "alignment", "sequences", "states", "nested", "corpora", "files", "evaluation", "neighbourhoods", "models", "streams"]


def load_queries():
    """All registered queries, in module order."""
    from tickloom.plans.registry import QUERIES

    for name in MODULES:
        importlib.import_module(f"tickloom.plans.{name}")
    return dict(QUERIES)
