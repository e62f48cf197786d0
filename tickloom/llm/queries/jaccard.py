"""Operator 4: components of ``documents`` under the Jaccard join of 4-word shingles at 0.85."""

from __future__ import annotations

from tickloom.llm import jaccard
from tickloom.llm.registry import Tables, query


@query("op4_jaccard_components", "op4")
def op4_jaccard_components(t: Tables):
    return jaccard.components(t.documents, k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")
