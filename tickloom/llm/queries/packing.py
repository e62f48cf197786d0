"""Operator 5: ``documents`` packed into sequences of 2048 ids."""

from __future__ import annotations

import public_tokenizers

from tickloom.llm import packing
from tickloom.llm.registry import Tables, query

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@query("op5_squares_packing", "op5")
def op5_squares_packing(t: Tables):
    return packing.pack(t.documents, public_tokenizers.path("word_bpe_49k.json"), end_id=1, with_ids=False).select(*COLUMNS)
