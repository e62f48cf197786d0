"""Operator 3: token-id files of ``documents``, written and read back."""

from __future__ import annotations

import public_tokenizers

from tickloom.llm import tokenids
from tickloom.llm.common import scratch
from tickloom.llm.registry import Tables, query


@query("op3_token_files", "op3")
def op3_token_files(t: Tables):
    path = scratch(t.spark, "token-ids")
    tokenids.write_tokens(t.documents, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenids.read_tokens(t.spark, path, with_ids=False)
