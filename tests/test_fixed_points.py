"""Fixed-point iterations and sketches against numpy, and the fence rule."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import ml, sketches


def test_bradley_terry_equals_the_iteration(spark):
    rng = np.random.default_rng(1)
    rows = [(f"i{a}", f"i{b}", int(n)) for a, b, n in zip(rng.integers(0, 7, 40), rng.integers(0, 7, 40), rng.integers(1, 9, 40))] + [("i0", "i9", 3), ("i3", "i3", 5)]
    items = sorted({x for a, b, _ in rows if a != b for x in (a, b)})
    won = np.zeros((len(items), len(items)))
    for a, b, n in rows:
        if a != b:
            won[items.index(a), items.index(b)] += n
    games, p = won + won.T, np.ones(len(items))
    for _ in range(6):
        p = won.sum(1) / np.divide(games, p[:, None] + p[None, :], out=np.zeros_like(games), where=games > 0).sum(1)
        p /= p.mean()
    got = {r["item"]: r["strength"] for r in ml.bradley_terry(spark.createDataFrame(rows, "winner string, loser string, n long"), 6).collect()}
    assert got.keys() == set(items) and np.allclose([got[i] for i in items], p)
    assert got["i9"] == 0  # never won
    assert ml.bradley_terry(spark.createDataFrame([], "winner string, loser string, n long"), 2).count() == 0


def test_unit_interval(spark):
    got = spark.createDataFrame([(-1.0,), (0.0,), (0.4,), (1.0,), (2.0,), (None,)], "x double").select(ml.unit_interval(F.col("x")).alias("y")).collect()
    assert np.allclose([r["y"] for r in got[:5]], [1 / (1 + np.e), 0, 0.4, 1, 1 / (1 + np.exp(-2))]) and got[5]["y"] is None


def test_lloyd_equals_the_iteration(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)).round(2)
    x[50:60] = x[50]  # equal first centres leave a code without rows
    frame = spark.createDataFrame(pd.DataFrame({"k": np.arange(200), "v": list(x)}))
    order = [r["k"] for r in frame.orderBy(F.md5(F.col("k").cast("string")), "k").limit(12).collect()]
    centres = x[order].copy()
    for _ in range(4):
        code = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        for c in range(12):
            if (code == c).any():
                centres[c] = x[code == c].mean(0)
    assert np.allclose(ml.lloyd(frame, "k", "v", 12, 4), centres)
    report = ml.codebook_report(frame.withColumn("g", F.lit(1)), "k", "v", 12, ["g"], 4).first()
    d = ((x[:, None] - centres[None]) ** 2).sum(-1)
    assert report["n"] == 200 and np.isclose(report["rmse"], np.sqrt(d.min(1).mean())) and report["codes_used"] == len(set(d.argmin(1)))


@pytest.mark.parametrize("days", [1, 30])
def test_sketches_of_many_days_stay_in_their_error(spark, tmp_path, days):
    rows = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.col("id") % days).alias("day"), F.when(F.col("id") % 2 == 0, F.floor(F.rand(5) * 4)).otherwise(F.exp(F.randn(6) * 3)).alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(2, 0, 5.0), (3, 0, None)], "g long, day long, x double"))
    for day in (0, 1):  # appended in two parts
        sketches.write_sketches(rows.filter(F.col("day") % 2 == day), str(tmp_path / "s"), ["g"], "day", "x")
    stored = sketches.merged(spark.read.parquet(str(tmp_path / "s")), ["g"])
    shares = [0.01, 0.25, 0.5, 0.75, 0.99]
    edges = stored.select("g", sketches.sketch_quantiles(F.col("sketch"), shares).alias("edges"))
    got = {r["g"]: r for r in sketches.rank_errors(rows, edges, ["g"], "x", shares).collect()}
    assert {g: r["n"] for g, r in got.items()} == {0: 100_000, 1: 100_000, 2: 1}
    assert all(r["error"] <= 2 * sketches.rank_error() for r in got.values())


def test_fenced_parts(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}',
        '```\n{"a": 1}': '{"a": 1}',
        "```python\nprint()\n```\nthen\n```json {\"b\": 2}```": '{"b": 2}',
        '  {"a": 1} ': '{"a": 1}',
        'text ```{"a": 1}```': 'text ```{"a": 1}```',
        "```none```": "```none```",
        "": "",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r["s"] for r in frame.select(text.strip_fence(F.col("t")).alias("s")).collect()] == list(cases.values())
