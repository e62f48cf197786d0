"""Models and queries of the text operators against independent versions, on small tables with odd rows."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import langid, load_llm_queries, urls, winnow
from tickloom.llm.queries.urls import labelled

ROWS = [
    (1, "Uno dos tres, quatro.\nthe line that everybody has in common here\nx", "es", "a", 3), (2, None, None, None, None), (3, "", "de", "b", 0), (4, "THE LINE that everybody has in common here ", "en", "a", 1),
    (5, "the line that everybody has in common here", "en", "a", 1), (6, "the line that everybody has in common here", None, "a", 1), (7, "the line that everybody has in common here", "en", "c", 1), (7, "second of seven é😀", "en", "c", 1),
    (None, "no id at all", "en", "a", 1), (9, "word " * 60_000, "en", "a", 1),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    turns = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (None, None, None, None), (2, 3, "user", ""), (3, 0, "tool", "No")]
    spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, cost int").write.parquet(f"{path}/conversations.parquet")
    return path


def test_sharding_query(spark, folder):
    got = load_llm_queries()["op8_slot_sharding"](spark, folder).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and 0 <= r["shard"] < 40 and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_new_queries_on_odd_rows(spark, folder):
    from oracle import check

    queries = load_llm_queries()
    for name in ("op11_merkle_manifest", "op12_conversation_repair", "op13_line_dedup", "op9_winnowing_decontamination"):
        assert check(spark, _duck(folder), folder, queries[name])[0] == "", name


def _duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con


def test_fingerprint_query(spark, folder):
    """Edited texts and likenesses again from the definition, with the operator's own fingerprints of single texts."""
    order = sorted(((i is not None, i or 0), t or "", i) for i, t, *_ in ROWS)
    rows = winnow.half_edited(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    texts = sorted({r["edited"] for r in rows} | {t for _, t, _ in order})
    table = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.transform(winnow.fingerprint(F.col("text")), lambda x: x["hash"]).alias("h"))
    marks = {r["text"]: set(r["h"]) for r in table.collect()}

    def like(a, b):
        return len(marks[a] & marks[b]) / len(marks[a] | marks[b]) if marks[a] | marks[b] else 1.0

    # rows of one id follow a hash of the text: take their order from the result
    got = {(str(r["doc_id"]), r["n_chars"], r["edited"][: r["n_chars"] - r["n_chars"] // 2]): r for r in rows}
    assert len(got) == len(ROWS)
    single = [k for k, (key, _, _) in enumerate(order) if sum(o[0] == key for o in order) == 1]
    checked = 0
    for k in single:
        _, text, i = order[k]
        after = order[(k + 1) % len(order)]
        if (k + 1) % len(order) not in single:
            continue
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = got[str(i), len(text), text[: len(text) - half]]
        assert r["edited"] == edited
        assert math.isclose(r["near_edited"], like(text, edited)) and math.isclose(r["near_next"], like(text, after[1]))
        checked += 1
    assert checked >= 5
    digests = load_llm_queries()["op7_winnowing_fingerprints"](spark, folder).collect()
    assert len(digests) == len(ROWS)
    same = {r["fingerprint"] for r in digests if r["doc_id"] in (5, 6)}
    assert len(same) == 1  # equal texts


def brute_decode(model, text):
    """Best language, score and lead of one text, gram by gram."""
    raw = " " + text.lower() + " "
    data = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in raw.encode())
    bits = model.code.shape[1]
    margin = np.zeros(bits)
    for size, table in enumerate(model.weights):
        codes = []
        for k in range(len(data) - 1 - size):
            gram = data[k : k + 2 + size]
            if gram.strip(b" ") == b"":
                continue
            if size == 0:
                code = gram[0] << 8 | gram[1]
            else:
                code = ((((gram[0] << 8 | gram[1]) << 8 | gram[2]) * 2654435761) & 0xFFFFFFFF) >> 16
            if code:
                codes.append(code)
        for b in range(bits):
            margin[b] += sum(float(table[b][c]) for c in codes) / max(len(codes), 1)
    loss = [sum(math.log1p(math.exp(-2 * m * w)) * r for m, w, r in zip(margin, word, model.reliability)) for word in model.code]
    share = np.exp(min(loss) - np.array(loss))
    share /= share.sum()
    ranked = np.sort(share)
    return int(share.argmax()), ranked[-1], ranked[-1] - ranked[-2]


def test_decoding_equals_brute_force(spark):
    train = [(i, " ".join(w[(i + j * j) % 4] for j in range(9)), name) for i in range(40) for name, w in {"aa": "alpha beta gamma delta".split(), "bb": "uno dos tres cuatro".split(), "cc": "ein zwei drei vier".split(), "dd": "été où ça va".split()}.items()]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    texts = ["alpha uno", "zwei", "OÙ ça", "x", "a  b", "alpha zwei tres été", "é", "1 2 3 drei!"]
    best, score, lead = model.decode(pa.array(texts))
    for i, t in enumerate(texts):
        b, s, g = brute_decode(model, t)
        assert b == best[i] and math.isclose(s, score[i], rel_tol=1e-4) and math.isclose(g, lead[i], rel_tol=1e-3, abs_tol=1e-5), t
    found = langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model, ambiguous_below=0.3).collect()
    assert [r["ambiguous"] for r in found] == [bool(x < 0.3) for x in lead] and any(r["ambiguous"] for r in found)


def test_equally_likely_languages(spark):
    """Of languages that score alike the first by name is taken, and the text is ambiguous."""
    rows = [(i, "same words", lang) for i in range(20) for lang in ("xx", "yy")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    r = langid.predict(spark.createDataFrame([("same words",)], "text string"), model).first()
    assert (r["lang_pred"], r["ambiguous"]) == ("xx", True) and math.isclose(r["score"], 0.5, abs_tol=1e-6)


def test_url_model_on_words_it_has_not_seen(spark):
    table = labelled(type("T", (), {"spark": spark})).coalesce(1)
    held = F.pmod(F.xxhash64("word"), F.lit(4)) == 1
    model = urls.fit_url_model(table.filter(~held))
    judged = urls.judge_urls(table.filter(held), model)
    right = judged.agg(F.avg(((F.col("verdict") == "block") == (F.col("blocked") == 1)).cast("double"))).first()[0]
    assert right >= 0.85


def test_pipeline_with_an_empty_benchmark_and_a_long_text(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, folder)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t, *_ in ROWS if t)
    once = stages["ngram_jaccard_join"](spark, docs, folder)
    assert sorted(str(r["doc_id"]) for r in once.collect()) == sorted(["1", "2", "3", "4", "7", "None", "9"])
    assert stages["benchmark_decontamination"](spark, docs, folder).count() == len(ROWS)
    assert stages["packing"](spark, docs, folder).agg(F.count_distinct("doc_id")).first()[0] == 8
