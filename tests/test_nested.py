"""Canonical JSON of random trees, and checksums of files in blocks."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tickloom.operators import trees
from tickloom.sources import digests, inventory

NAMES = ["a", "b", "é", "z z", 'q"', "score", "player", "tick", "x\n", "😀", "￿", ""]


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice([None, True, False, rng.randint(-9, 10**12), 1.5, -0.25, "", 'é"\\/\n\x01\x1f\x7f', "😀", "2"])
    if kind < 0.65:
        return [tree(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {n: tree(rng, depth - 1) for n in rng.sample(NAMES, rng.randint(0, 5))}


def stripped(x):
    if isinstance(x, dict):
        return {k: stripped(v) for k, v in x.items() if k not in trees.REDACTED}
    return [stripped(v) for v in x] if isinstance(x, list) else x


def test_canonical_texts_equal_a_recursive_walk(spark):
    rng = random.Random(11)
    states = [tree(rng, d) for d in (0, 1, 2, 3, 4, 5, 6) for _ in range(40)]
    deep = {"a": 1}
    for _ in range(30):
        deep = {"w": [deep, {"score": deep}]} if _ % 9 == 0 else [deep]
    states.append(deep)
    texts = [json.dumps(s, ensure_ascii=rng.random() < 0.5) for s in states] + [json.dumps(states[50])] * 3
    states += [states[50]] * 3
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, state string, canonical string")
    got = {r["i"]: r["canonical"] for r in trees.canonical_texts(frame, "state").collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(states):
        assert got[i] == json.dumps(stripped(s), sort_keys=True, ensure_ascii=False), texts[i]
    kept = {r["i"]: r["canonical"] for r in trees.canonical_texts(frame, "state", drop=[]).collect()}
    assert all(kept[i] == json.dumps(s, sort_keys=True, ensure_ascii=False) for i, s in enumerate(states))


def test_no_canonical_text(spark):
    frame = spark.createDataFrame([(None,), ("",), ("{",), ("nope",), ("[1,",), ('{"a": 1, "a": 2}',)], "state string")
    assert [r["canonical"] for r in trees.canonical_texts(frame, "state").collect()] == [None] * 6
    assert trees.canonical_texts(frame.limit(0), "state").count() == 0


def test_digests_of_files_above_a_block(spark, tmp_path):
    rng = random.Random(12)
    bodies = {"one.bin": b"x", "block.bin": rng.randbytes(1000), "more.bin": rng.randbytes(25_001), "chunks.bin": rng.randbytes(digests.CHUNK + 5)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    files = inventory.list_files(spark, str(tmp_path), ["bin"])
    plain = {r["name"]: r["sha256"] for r in inventory.list_files(spark, str(tmp_path), ["bin"], with_sha=True).collect()}
    assert plain == {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}
    block = 1000
    trees_ = {r["path"].rsplit("/", 1)[1]: r["tree"] for r in digests.tree_digests(files.select("path", "bytes"), block).collect()}
    for name, body in bodies.items():
        parts = [body[i : i + block] for i in range(0, len(body), block)] or [b""]
        assert trees_[name] == hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()
    small = digests.block_digests(files.select("path", "bytes"), block).filter(F.col("path").endswith("more.bin"))
    assert sorted((r["block"], r["size"]) for r in small.collect()) == [(i, 1000) for i in range(25)] + [(25, 1)]
