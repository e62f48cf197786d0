"""Operator 6: the language of every document; a quarter of the documents is held out from learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import langid
from tickloom.llm.registry import Tables, query

def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op6_ecoc_language", "op6")
def op6_ecoc_language(t: Tables):
    docs = t.documents
    model = langid.fit(docs.filter(~held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
