"""Operators of a text-corpus pipeline; nothing else in the library imports this package."""

from __future__ import annotations

import importlib

MODULES = ["urls", "licences", "tokenids", "jaccard", "packing", "langid", "winnow", "slots", "decontam", "chat", "merkle", "turns", "lines"]


def load_llm_queries():
    """All registered queries of the text operators, in operator order."""
    from tickloom.llm.registry import QUERIES

    for name in MODULES:
        importlib.import_module(f"tickloom.llm.queries.{name}")
    return dict(sorted(QUERIES.items(), key=lambda q: int(q[0][2:].split("_")[0])))
