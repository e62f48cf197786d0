"""What must not grow faster than the input: rows a task sorts, state calls, shuffles, texts read, passes over terms."""

import pickle
import random

from pyspark.sql import functions as F


def test_as_of_joins_deal_rows_to_parts_of_bounded_size(spark, monkeypatch):
    """Large tables get more partitions than a shuffle has, and ticks shared by frames and events count on both sides."""
    from tickloom.operators import align

    monkeypatch.setattr(align, "PART_ROWS", 25, raising=False)
    rng = random.Random(18)
    keys = [None, *range(60)]
    frames = [(rng.choice(keys), rng.randint(0, 30), i) for i in range(400)]
    events = [(rng.choice(keys), rng.randint(0, 30), p) for p in range(300)]
    f, e = spark.createDataFrame(frames, "k int, t int, i int"), spark.createDataFrame(events, "k int, t int, p int")
    both = align.bracketing_events(f, e, ["k"], "t", ["p"])
    assert both.rdd.getNumPartitions() == 28  # 700 rows
    for got, strict in ((both, False), (align.next_event(align.last_event(f, e, ["k"], "t", ["p"], name="back", strict=True), e, ["k"], "t", ["p"], name="ahead", strict=True), True)):
        found = {r["i"]: (r["back"] and tuple(r["back"]), r["ahead"] and tuple(r["ahead"])) for r in got.collect()}
        assert len(found) == 400
        for k, t, i in frames:
            before = [(at, p) for of, at, p in events if of == k and (at < t if strict else at <= t)]
            after = [(at, p) for of, at, p in events if of == k and (at > t if strict else at >= t)]
            assert found[i] == (max(before, default=None), min(after, default=None))


def test_a_stream_keeps_rows_in_few_entries():
    """Rows of different hours share entries, at most ``SMALL_ROWS`` each and never a part of an hour, and come out in order."""
    import pandas as pd

    from tickloom.streaming import stateful

    class State:
        def __init__(self):
            self.held, self.writes = {}, 0

        def exists(self):
            return None in self.held

        def get(self):
            return self.held.get(None)

        def update(self, v):
            self.held[None] = v

        def updateValue(self, k, v):
            self.writes += 1
            self.held[k] = v

        def getValue(self, k):
            return self.held[k]

        def removeKey(self, k):
            del self.held[k]

        def keys(self):
            return iter([*self.held])

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getValueState(self, name, schema):
            return self.states.setdefault(name, State())

        def getMapState(self, name, key, value):
            return self.getValueState(name, key)

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Mark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    def advance(state, rows):
        return ((state[0] or 0) + len(rows),), [(state[0] or 0) + i for i in range(len(rows))]

    hour, handle = 3_600_000_000, Handle()
    work = stateful.OrderedState([("us", "bigint"), ("n", "int"), ("v", "double"), ("s", "string")], "at", ["us"], [("n", "bigint")], advance, "place", None)
    work.init(handle)
    us = [i * hour for i in range(300)] + [7 * hour + i for i in range(1, 300)]
    random.Random(7).shuffle(us)
    rows = pd.DataFrame({"us": us, "n": [None if u % 3 else u % 5 for u in us], "v": [None if u % 2 else 0.5 for u in us], "s": [None if u % 2 else "x" for u in us], "at": pd.to_datetime(us, unit="us")})
    assert [*work.handleInputRows(1, iter([rows[:400], rows[400:]]), Mark(0))] == []
    waiting = handle.states["waiting"]
    assert waiting.writes <= 8 and sorted(r[1] for v in waiting.held.values() for r in pickle.loads(v[0])) == sorted(us)
    out = pd.concat([*work.handleExpiredTimer(1, Mark(100 * 3_600_000), None), *work.handleExpiredTimer(1, Mark(10**10), None)])
    assert out["us"].tolist() == sorted(us) and out["place"].tolist() == [*range(len(us))] and not waiting.held
    plain = out.astype(object).where(out.notna(), None)
    assert [(n, v, s) for n, v, s in zip(plain["n"], plain["v"], plain["s"])] == [(None if u % 3 else u % 5, None if u % 2 else 0.5, None if u % 2 else "x") for u in sorted(us)]


def test_trees_are_written_without_a_shuffle(spark):
    """Rows keep their columns and places, equal texts included; no row meets another."""
    import json

    from tickloom.operators import trees

    deep = {"b": [1, {"score": 2, "z": None}], "a": {}, "": []}
    for _ in range(9):
        deep = {"k": [deep], "é": "q\"\n"}
    texts = [json.dumps(deep), "1.50", '"x"', None, "{", json.dumps(deep), "[]", "null"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, state string")
    out = trees.canonical_texts(frame, "state")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["i", "state", "canonical"]
    del deep["k"][0]["k"][0]["k"][0]["k"][0]["k"][0]["k"][0]["k"][0]["k"][0]["k"][0]["b"][1]["score"]
    whole = json.dumps(deep, sort_keys=True, ensure_ascii=False)
    assert [r["canonical"] for r in out.orderBy("i").collect()] == [whole, "1.5", '"x"', None, None, whole, "[]", "null"]


def test_templated_texts_are_read_once(spark):
    """What is read of a text is joined back alike however large the list is, null texts included."""
    from tickloom.functions import text

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"push b {i % 3}") for i in range(40)], "i int, t string")
    plain = {r["i"]: r["b"] for r in text.with_behaviour(rows, "t", "b").collect()}
    for limit in (0, 1 << 20):
        once = text.read_once(rows, "t", lambda texts: text.with_behaviour(texts, "t", "b"), limit=limit)
        assert {r["i"]: r["b"] for r in once.collect()} == plain and once.columns == ["i", "t", "b"]


def test_alignment_reads_templated_texts_once(spark):
    from tickloom.plans.registry import QUERIES
    from tickloom.plans import states  # noqa: F401

    plan = QUERIES["behaviour_alignment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "Contains(" not in plan


def test_a_chunk_of_the_join_is_small(spark):
    """What hashing a chunk of text takes at its peak; two workers run beside an executor's heap."""
    import tracemalloc

    import pyarrow as pa

    from tickloom.llm import jaccard

    rng = random.Random(4)
    texts = [" ".join(str(rng.randint(0, 10**6)) for _ in range(700)) for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(range(900)), pa.array(texts)], names=["doc_id", "text_hash", "text"])
    jaccard._powers.clear()
    tracemalloc.start()
    rows = sum(b.num_rows for b in jaccard._profile(5)(iter([batch])) if b.column("doc_id").null_count == 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    jaccard._powers.clear()
    assert rows == 900 and peak < 80e6
