"""Every registered query against its SQL on the small tables; ordered ones again with hot keys split."""

from pathlib import Path

import pytest
from oracle import check, duck

from tickloom.plans import load_queries

FOLDER = "/root/testdata/sf0.001"
ROUNDING = 2e-4  # means of short decimals can sit on a rounding edge, which the two engines resolve differently
QUERIES = load_queries()
SPLIT = [
    "asof_backward_capped", "asof_forward_label", "asof_nearest_tie", "range_first_in_window", "interval_labels", "downsample_nth_present",
    "running_score", "displacement_velocity", "hold_until_reset", "time_since_true_reset", "trailing_mean", "causal_mean_range",
    "forward_window_counts", "segment_ids_stats", "auc_by_group", "auc_ordinal", "quantile_edges", "quantile_methods", "entity_split", "topk_per_group",
    "activity_frames", "vocabulary", "episode_export",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no input tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    problem, rows, _ = check(spark, con, FOLDER, QUERIES[name], ROUNDING)
    assert not problem
    assert rows >= 0


@pytest.mark.parametrize("name", SPLIT)
def test_query_with_hot_keys(tight, con, name):
    problem, _, _ = check(tight, con, FOLDER, QUERIES[name], ROUNDING)
    assert not problem


def test_streams_equal_batch(spark):
    a = {tuple(r) for r in QUERIES["stream_integrate_and_fire"](spark, FOLDER).collect()}
    b = {(r["user_id"], r["event_id"]) for r in QUERIES["integrate_and_fire"](spark, FOLDER).collect()}
    assert a == b and a


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_streams_in_any_order_of_files_equal_the_batch(spark, tmp_path):
    """Shuffled files, one per trigger: nothing is lost and nothing is decided too early."""
    from pyspark.sql import functions as F

    from tickloom.streaming import stateful

    rows = [(k, 10**9 + i * 60_000_000 + k, i % 3 == 0, float(i % 5)) for k in range(4) for i in range(25)]
    events = spark.createDataFrame(rows, "k long, us long, flag boolean, v double").withColumn("at", F.timestamp_micros("us"))
    for part in range(4):
        events.filter(F.pmod(F.xxhash64("k", "us"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(-1, 10**12, False, 0.0)], "k long, us long, flag boolean, v double").withColumn("at", F.timestamp_micros("us"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stateful.use_rocksdb(spark)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stateful.integrate_and_fire(source, "k", "at", "1 day", ["us"], "v", 6.0)
    assert stateful.drain(stream, str(tmp_path / "out"), str(tmp_path / "state")) == 0
    got = sorted((r["k"], r["us"], r["fires"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["k"] >= 0)
    want = []
    for k in range(4):
        level = 0.0
        for _, us, _, v in sorted(r for r in rows if r[0] == k):
            level += v
            want.append((k, us, level >= 6.0))
            level = 0.0 if level >= 6.0 else level
    assert got == want


@pytest.mark.parametrize("small", [64, 1000])
def test_streams_hold_a_frame_of_a_key_at_once(spark, tmp_path, monkeypatch, small):
    """All rows expire at once, and still no step gets more than a frame of whole hours of the key."""
    from pyspark.sql import functions as F

    from tickloom.streaming import stateful

    monkeypatch.setattr(stateful, "FRAME_ROWS", 12, raising=False)
    monkeypatch.setattr(stateful, "SMALL_ROWS", small, raising=False)

    def advance(state, rows):
        before = int(state[0] or 0)
        return (before + len(rows),), [f"{before + i} {len(rows)}" for i in range(len(rows))]

    rows = [(1, 10**9 + i * 600_000_000) for i in range(500)] + [(-1, 10**13)]
    spark.createDataFrame(rows, "k long, us long").withColumn("at", F.timestamp_micros("us")).repartition(3).write.parquet(str(tmp_path / "in"))
    stateful.use_rocksdb(spark)
    source = spark.readStream.schema("k long, us long, at timestamp").parquet(str(tmp_path / "in"))
    stream = stateful.run_ordered(source, "k", "at", "1 day", ["us"], [("n", "bigint")], advance, ("step", "string"))
    assert stateful.drain(stream, str(tmp_path / "out"), str(tmp_path / "state")) == 0
    got = sorted((r["us"], *map(int, r["step"].split())) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["k"] == 1)
    assert [(us, place) for us, place, _ in got] == [(us, i) for i, (k, us) in enumerate(rows) if k == 1]
    assert max(held for _, _, held in got) <= 12 + 6


def test_every_broken_rule_is_reported(spark):
    from pyspark.sql import functions as F

    from tickloom.operators import quality

    rows = spark.createDataFrame([(1, 1), (2, 5)], "e int, f int")
    rules = {f"rule{i:02d}": F.col("f") > 1 for i in range(25)}
    report = quality.invariant_report(rows, rules, ["e"], ["e", "f"])
    assert report.count() == 25 and len(quality.violations(report)) == 25


def test_unfinished_survey_items_are_not_claimed():
    assert not {"P31", "P34", "J23"} & {c for q in QUERIES.values() for c in q.covers}


def test_queries_load_without_a_session():
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 0, done.stderr
