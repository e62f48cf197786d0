"""Tables dealt by key once: what they meet without another shuffle is what joins give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators import blocks, ordered
from tickloom.plans import load_queries


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def exchanges(df):
    return re.findall(r"hashpartitioning\(([^\[]*), \d+\)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()))


def test_unions_of_dealt_tables_are_joins(spark):
    rng = random.Random(3)
    keys = [None, "a", "b", "c"]
    left = spark.createDataFrame([(rng.choice(keys), rng.choice([None, 1, 2]), i) for i in range(60)], "k string, t int, i int")
    left = left.unionByName(left.limit(5))
    one = spark.createDataFrame([("a", 1, 1.5, None), ("a", None, None, "x"), (None, None, 2.5, "y"), ("z", 1, 3.5, "z")], "k string, t int, v double, s string")
    two = one.select("k", "t", F.array("s").alias("w"))
    many = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, None), (None, None, None), ("z", 3, "q")], "k string, p int, q string")
    want = rows_of(ordered.beside(left, [one, two], ["k", "t"])), rows_of(ordered.meeting(left, many, ["k"])), rows_of(ordered.per_key(left, ["k"], {"m": F.max("i")}))
    with ordered.bounded_groups([(left, ["k"])]) as n:
        assert n == 65
        got = ordered.beside(left, [one, two], ["k", "t"]), ordered.meeting(left, many, ["k"]), ordered.per_key(left, ["k"], {"m": F.max("i")})
        assert (*map(rows_of, got),) == want
        parts = ordered.parts_for(spark, n)
        near = [ordered.near(df, ["k"], parts) for df in (left, one, two, many)]
        out = ordered.per_key(ordered.meeting(ordered.beside(near[0], near[1:3], ["k", "t"]), near[3], ["k"]), ["k"], {"m": F.max("i")})
    assert exchanges(out) == ["k"] * 4
    assert ordered.near(left, ["k"], 4) is left  # not known to be bounded


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    at = tmp_path_factory.mktemp("tables")
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string"
    lines = [(rng.choice([None, *range(150)]), rng.randint(1, 400), rng.randint(1, 100), rng.randint(1, 7), float(rng.randint(1, 50)), float(rng.randint(900, 90_000)), rng.randint(0, 8) / 100, rng.choice("RAN"), rng.choice("OF")) for _ in range(900)]
    spark.createDataFrame(lines, line).write.parquet(str(at / "lineitem.parquet"))
    spark.createDataFrame([(k, rng.randint(1, 90)) for k in range(150)], "o_orderkey long, o_custkey long").write.parquet(str(at / "orders.parquet"))
    return str(at)


@pytest.mark.parametrize("name", ["feature_export", "drop_positions", "round_context", "round_frames_players"])
def test_ticks_are_shuffled_once(spark, folder, name):
    """Ticks lie in buckets by round, and nothing of a tick, frame or text is shuffled after that."""
    out = load_queries()[name](spark, folder)
    assert out.count() > 100
    assert not [x for x in exchanges(out) if re.search("tick|frame|slot|steamid|id", x)]
    assert "Bucketed: true" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["round_context", "round_frames_players"])
def test_large_rounds_are_joined(spark, folder, name):
    """Rounds too large for a task are neither dealt nor bucketed, and the rows are the same."""
    q = load_queries()[name]
    want = rows_of(q(spark, folder))
    spark.conf.set("tickloom.groupLimit", "60")
    try:
        assert rows_of(q(spark, folder)) == want
    finally:
        spark.conf.unset("tickloom.groupLimit")


def test_a_lone_block_comes_with_its_index(spark, tmp_path):
    rng = random.Random(8)
    lines = spark.createDataFrame([(f"k{i % 5}", rng.randint(0, 40), f"l{i}") for i in range(200)], "g string, tick int, line string")
    asks = spark.createDataFrame([(i, rng.choice([None, "none", "k0", "k1", "k4"]), rng.choice([None, *range(-2, 45)])) for i in range(150)], "__id int, g string, at int")
    found = []
    for size in (7, 256):
        store = blocks.store_blocks(lines, f"test_lone_{size}", ["g"], "tick", ["line"], block_rows=size, buckets=3, tie=["line"], path=str(tmp_path / f"s{size}"))
        assert store.single == (size == 256) and store.index.columns == ["g", "starts", "ends"]
        found.append(rows_of(store.upto(asks, "at", "line").select("__id", "g", "at", "lines")))
        with ordered.bounded_groups([(asks, ["g"])]):
            assert rows_of(store.upto(asks.repartition(3, "g"), "at", "line").select("__id", "g", "at", "lines")) == found[0]
        if store.single:
            assert "__id" not in " ".join(exchanges(store.upto(asks, "at", "line")))
    assert found[0] == found[1]
