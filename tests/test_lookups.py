"""Stored blocks: nearest lookups and texts up to a tick, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.operators import blocks, context


def test_bisect(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.randint(0, 9) for _ in range(n)), rng.randint(-1, 10)) for n in (0, 1, 2, 3, 7, 8, 9, 100) for _ in range(8)]
    frame = spark.createDataFrame(rows, "a array<int>, v int").select("a", "v", blocks.bisect(F.col("a"), F.col("v")).alias("upto"), blocks.bisect(F.col("a"), F.col("v"), strict=True).alias("below"))
    for r in frame.collect():
        assert (r["upto"], r["below"]) == (sum(x <= r["v"] for x in r["a"]), sum(x < r["v"] for x in r["a"]))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(2)
    rows = [(d, n, rng.randint(0, 500), [float(ord(d)), float(n), float(k)]) for d in ("a", "b") for n in (1, 2) for k in range(60)]
    rows += [("hot", 1, 7 * k, [9.0, 9.0, float(k)]) for k in range(300)] + [(None, 1, 5, [0.0] * 3), ("a", None, 5, [0.0] * 3), ("a", 1, None, [0.0] * 3)]
    table = spark.createDataFrame(rows, "demo string, n int, tick int, v array<float>")
    store = blocks.store_blocks(table, "test_vectors", ["demo", "n"], "tick", ["v"], block_rows=8, buckets=4, tie=None)
    least = {}
    for d, n, tick, v in rows:
        if None not in (d, n, tick):
            least[d, n, tick] = min(v, least.get((d, n, tick), v))
    yield store, least
    store.drop()


def brute_nearest(least, key, at, tie):
    ticks = sorted(t for d, n, t in least if (d, n) == key)
    if not ticks or at is None or None in key:
        return None
    return least[(*key, min(ticks, key=lambda t: (abs(t - at), t if tie == "earlier" else -t)))]


@pytest.mark.parametrize("tie", ["earlier", "later"])
@pytest.mark.parametrize("limit", [None, 20])
def test_lookup_batch(spark, vectors, tie, limit):
    store, least = vectors
    rng = random.Random(3)
    keys = [(rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, None]), rng.choice([None, *range(-5, 510)])) for _ in range(300)] + [("hot", 1, k * 5) for k in range(450)] + [("a", 1, 44)] * 30
    batch = spark.createDataFrame([(i, *k, "x") for i, k in enumerate(keys)], "id int, demo string, n int, at int, found string")
    if limit:
        spark.conf.set("tickloom.groupLimit", str(limit))
    try:
        got = {r["id"]: (r["found"], list(r["v"])) for r in store.lookup_batch(batch, "at", "v", 3, tie).collect()}
    finally:
        spark.conf.unset("tickloom.groupLimit")
    assert len(got) == len(keys)
    for i, (d, n, at) in enumerate(keys):
        want = brute_nearest(least, (d, n), at, tie)
        assert got[i] == (want is not None, want or [0.0] * 3), keys[i]
    assert store.lookup_batch(batch.limit(0), "at", "v", 3).count() == 0


def test_the_cache_is_not_shuffled(spark, vectors):
    store, _ = vectors
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        batch = spark.range(1000).select("id", F.chr(F.col("id") % 3 + 97).alias("demo"), (F.col("id") % 3).cast("int").alias("n"), F.col("id").cast("int").alias("at"))
        plan = store.lookup_batch(batch, "at", "v", 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # of two joins only the batch's side has an exchange: by key, then by key and block
    assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("limit", [None, 5])
def test_texts_up_to_a_tick(spark, limit):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randint(0, 60), f"e{k}") for k in range(200)]
    store = blocks.store_blocks(spark.createDataFrame(rows, "g string, tick int, line string"), "test_events", ["g"], "tick", ["line"], block_rows=7, buckets=2, tie=["line"])
    asks = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-2, 65)])) for i in range(150)]
    if limit:
        spark.conf.set("tickloom.groupLimit", str(limit))
    try:
        got = {r["__id"]: r["lines"] for r in store.upto(spark.createDataFrame(asks, "__id int, g string, at int"), "at", "line").collect()}
    finally:
        spark.conf.unset("tickloom.groupLimit")
        store.drop()
    by = defaultdict(list)
    for g, tick, line in sorted(rows):
        by[g].append((tick, line))
    for i, g, at in asks:
        want = [x for t, x in by[g] if at is not None and t <= at]
        assert got[i] == ("\n".join(want) if want else None)


def test_context(spark):
    players = [
        ("m", 2, t, s, f"n{s}", side, hp, 50 if s == 1 else None, True, ["AK-47", "Glock-18", "Smoke Grenade"] if s == 1 else None)
        for t in (80, 112) for s, side, hp in ((1, "t", 100), (2, "t", 0 if t > 100 else 60), (3, "ct", 30), (4, "T", 0))
    ]
    players = spark.createDataFrame(players, "demo_stem string, round_num int, tick int, steamid long, name string, side string, health int, armor int, has_helmet boolean, inventory array<string>")
    events = [("m", 2, 96, "death", "n2", "t"), ("m", 2, 112, "plant", None, None), ("m", 2, 90, "pickup", None, None), ("m", 2, 113, "defused", None, None), ("m", 1, 5, "death", "n1", "t")]
    events = spark.createDataFrame(events, "demo_stem string, round_num int, tick int, kind string, player string, side string")
    rounds = spark.createDataFrame([("m", 1, 64, "T"), ("m", 2, 80, "ct")], "demo_stem string, round_num int, freeze_end int, winner string")
    header = spark.createDataFrame([("m", "de_x")], "demo_stem string, map_name string")
    got = {(r["tick"], r["steamid"]): r["context"] for r in context.round_context(players, events, rounds, header, "test_context", block_rows=1).collect()}
    spark.sql("DROP TABLE test_context_blocks")
    spark.sql("DROP TABLE test_context_index")
    assert got[112, 1] == (
        "Round 2 | T 1 - 0 CT | de_x\nRound time: 0s\n\nECONOMY (round start):\n  T-side: force-buy (~$3,900)\n  CT-side: eco (~$0)\n\n"
        "ROUND EVENTS:\n    0.2s — n2 (T) eliminated\n    0.5s — Bomb planted\n\nCURRENT STATE:\n  Alive: 1T vs 1CT\n  Bomb: planted\n"
        "  POV: n1 (T), 100hp/50armor, AK-47, utility: Smoke Grenade\n  Teammates dead: n2, n4"
    ), got[112, 1]
    assert "ROUND EVENTS" not in got[80, 3] and got[80, 3].endswith("Bomb: carried\n  POV: n3 (CT), 30hp/0armor, knife, utility: none")
    assert "Teammates alive: n2 (60hp, knife)\n  Teammates dead: n4" in got[80, 1]
