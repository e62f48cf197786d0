"""Operator 7: fingerprints of ``documents`` and of their half edited texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.llm import winnow
from tickloom.llm.registry import Tables, query


def digest(fp: str) -> Column:
    """One string for a whole fingerprint, hashes and places (empty for the empty one)."""
    return F.when(F.size(fp) == 0, "").otherwise(F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), F.col(fp))), 16, "0") for i in range(2)])))


@query("op7_winnowing_fingerprints", "op7")
def op7_winnowing_fingerprints(t: Tables):
    found = winnow.half_edited(t.documents)
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("fp").alias("fingerprint"),
        digest("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next",
    )
