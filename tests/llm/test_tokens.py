"""Token files and packing against the library's own encoding of whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import packing, tokenids
from tickloom.llm.common import scratch
from tickloom.llm.encode import WordEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "bc", " ", "  ", "\n", "\n\n", "\t", "'s", "'S", "d,", "x!?", ".", "é", "é", "Σ", " ", " ", "3", "12", "<|endoftext|>", "日本", "\x01", "\x1c", "  \n", "\r\n", "😀", ",,", "ſ", "İ", "İ.", ";"]


def whole(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "spaced"), [(BYTES, True), (WORDS, False)])
def test_word_wise_ids_equal_the_librarys(path, spaced):
    rng, encoder = random.Random(3), WordEncoder(path, spaced)
    for _ in range(12):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None]
        ids, starts = encoder.encode(pa.array(texts, pa.string()))
        for i, e in enumerate(encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            assert ids[starts[i] : starts[i + 1]].tolist() == e.ids, repr(texts[i])


ROWS = [(3, "one two three."), (None, "no id"), (1, None), (2, ""), (2, "twice"), (2, "twice"), (-5, "long " * 9000), (7, "ends\n\n")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, ids string, start int")


def test_files_hold_every_id_in_order(spark):
    path = scratch(spark, "t")
    tokenids.write_tokens(table(spark, ROWS).repartition(3), path, BYTES, end_id=2)
    rows = sorted(tokenids.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    got, at = {}, 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        got.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
    for i in {r[0] for r in ROWS}:
        assert sorted(got[i]) == sorted(whole(BYTES, t) + [2] for j, t in ROWS if j == i)
    short = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in tokenids.read_tokens(spark, path, with_ids=False).collect()}
    assert short == {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in rows}


def test_no_documents(spark):
    path = scratch(spark, "t")
    tokenids.write_tokens(table(spark, []), path, BYTES, end_id=2)
    assert tokenids.read_tokens(spark, path).count() == 0
    assert packing.pack(table(spark, []), WORDS, 1).count() == 0


def test_pieces_cover_every_id_once_without_padding(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("ab cd efg hij".split()) for _ in range(rng.randint(0, 300)))) for i in range(300)] + [r for r in ROWS if r[0] not in (2, None)] 
    rows = packing.pack(table(spark, docs), WORDS, 1, capacity=256, max_open=8).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    wanted = {}
    for i, t in docs:
        wanted.setdefault(i, []).append(whole(WORDS, t) + [1])
    for i, texts in wanted.items():
        if len(texts) > 1:
            continue
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in pieces for x in np.frombuffer(r["ids"], "<u4").tolist()] == texts[0]
        assert {r["doc_tokens"] for r in pieces} == {len(texts[0])}
    assert sum(r["length"] for r in rows) == sum(len(x) for texts in wanted.values() for x in texts)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        fill = 0
        for r in pieces:
            assert r["offset"] == fill
            fill += r["length"]
        assert fill <= 256 and fill & (fill - 1) == 0


def test_a_document_takes_the_level_with_the_least_squares():
    packer = packing.SquaresPacker(10, lambda w: None)
    for doc, size in enumerate([6, 6, 3]):
        packer.add(doc, np.zeros(size, np.int32))
    # two windows of fill 6: 4 -> 1 + 1 by joining one of them, 4 + 1 by a new window
    assert packer.count.tolist() == [0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0]
    packer.add(3, np.zeros(4, np.int32))
    assert packer.count.tolist() == [0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0]
