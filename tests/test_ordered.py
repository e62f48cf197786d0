"""Ordered building blocks against pandas, with one key that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import metrics, neighbors, ordered, windows
from tickloom.operators.ordered import framed, quantiles, rcount, rmax, rsum, running


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    n = 1500
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 30, n))
    at = np.where(rng.random(n) < 0.5, rng.integers(0, 40, n), rng.integers(0, 100000, n))  # a burst and a tail
    return pd.DataFrame({"k": key, "at": at.astype("int64"), "id": np.arange(n), "v": rng.normal(size=n).round(3)})


@pytest.mark.parametrize("limit", [10, 100, 10**6])
def test_running(spark, skewed, limit):
    df = spark.createDataFrame(skewed)
    out = running(df, ["k"], "at", {"s": rsum(F.col("v")), "m": rmax(F.col("v"))}, {"left": rcount()}, tie=["id"], limit=limit).toPandas()
    want = skewed.sort_values(["k", "at", "id"])
    g = want.groupby("k")
    want = want.assign(s=g.v.cumsum(), m=g.v.cummax(), left=g.cumcount(ascending=False) + 1)
    got = out.set_index("id").loc[want.id]
    assert np.allclose(got.s, want.s) and np.allclose(got.m, want.m) and (got.left.to_numpy() == want.left.to_numpy()).all()


@pytest.mark.parametrize("limit", [10, 64, 10**6])
def test_row_frames(spark, skewed, limit):
    df = spark.createDataFrame(skewed)

    def exprs(w):
        return {"p": F.lag("v", 3).over(w), "n": F.lead("v", 2).over(w), "mean": F.avg("v").over(w.rowsBetween(-3, 2))}

    out = framed(df, ["k"], "at", exprs, before=3, after=2, tie=["id"], limit=limit).toPandas().set_index("id")
    want = skewed.sort_values(["k", "at", "id"])
    g = want.groupby("k").v
    assert len(out) == len(want)
    got = out.loc[want.id]
    assert np.allclose(got.p, g.shift(3), equal_nan=True) and np.allclose(got.n, g.shift(-2), equal_nan=True)


@pytest.mark.parametrize("limit", [10, 10**6])
def test_range_frames(spark, skewed, limit):
    df = spark.createDataFrame(skewed)
    out = framed(df, ["k"], "at", lambda w: {"c": F.count(F.lit(1)).over(w.rangeBetween(-50, 20))}, before=50, after=20, unit="range", limit=limit)
    got = out.toPandas().set_index("id").c
    for _, r in skewed.sample(60, random_state=2).iterrows():
        same = skewed[(skewed.k == r.k) & skewed["at"].between(r["at"] - 50, r["at"] + 20)]
        assert got[r.id] == len(same)


@pytest.mark.parametrize("limit", [10, 10**6])
def test_quantiles(spark, skewed, limit):
    df = spark.createDataFrame(skewed)
    probs = {"a": 0.0, "b": 1 / 6, "c": 0.5, "d": 0.95, "e": 1.0}
    per = quantiles(df, ["k"], "v", probs, limit=limit).toPandas().set_index("k")
    for k, g in skewed.groupby("k"):
        assert np.allclose(per.loc[k, list(probs)].astype(float), np.quantile(g.v, list(probs.values())))
    whole = quantiles(df, [], "v", probs, limit=limit).first()
    assert np.allclose([whole[p] for p in probs], np.quantile(skewed.v, list(probs.values())))
    low = quantiles(df, [], "v", {"m": 0.5}, method="lower", limit=limit).first()["m"]
    assert low == np.sort(skewed.v)[(len(skewed) - 1) // 2]


def test_plain_plan_is_one_shuffle(spark, skewed):
    df = spark.createDataFrame(skewed)
    plan = running(df, ["k"], "at", {"s": rsum(F.col("v"))})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_bounded_groups_skips_the_probe_only_when_true(spark, skewed):
    df = spark.createDataFrame(skewed)
    with ordered.bounded_groups([(df, ["k"])], limit=10**6):
        assert not ordered.splits_needed(ordered.hot_ranges(df, ["k"], "at", 10))
    with ordered.bounded_groups([(df, ["k"])], limit=50):
        assert ordered.splits_needed(ordered.hot_ranges(df, ["k"], "at", 50))


def test_a_check_covers_finer_keys_but_no_coarser_ones(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("sub", F.col("at") % 3).withColumn("all", F.lit(1))
    with ordered.bounded_groups([(df, ["k"])], limit=10**6):
        assert not ordered.splits_needed(ordered.hot_ranges(df, ["k", "sub"], "at", 10))
        assert ordered.splits_needed(ordered.hot_ranges(df, ["all"], "at", 10))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("pivots,block", [(4, 7), (16, 10000)])
def test_knn_equals_brute_force(spark, metric, pivots, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6)) * 5
    x = np.concatenate([centres[i % 4] + rng.normal(size=6) for i in range(120)]).reshape(-1, 6).round(3)
    x[40:80] = x[40]  # a third of the rows are copies
    pdf = pd.DataFrame({"id": np.arange(len(x)), "vector": list(x), "ep": np.arange(len(x)) % 7, "y": np.arange(len(x)) % 2})
    df = spark.createDataFrame(pdf)
    got = neighbors.knn(df, df, 9, metric=metric, mask="ep", payload=["y"], pivots=pivots, block_rows=block).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(-1))
    d[pdf.ep.to_numpy()[:, None] == pdf.ep.to_numpy()[None]] = np.inf
    assert (got.groupby("qid").size() == 9).all() and got.qid.nunique() == len(x)
    for q, g in got.groupby("qid"):
        assert np.allclose(np.sort(g.distance), np.sort(d[q])[:9], atol=1e-6)


def test_knn_returns_what_exists(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": [0, 1, 2], "vector": [[0.0, 1], [1.0, 1], [2.0, 1]], "ep": [0, 1, 1]}))
    got = neighbors.knn(df, df, 5, mask="ep").groupBy("qid").count().toPandas().set_index("qid")["count"]
    assert dict(got) == {0: 2, 1: 1, 2: 1}


def test_greedy_matches(spark):
    rng = np.random.default_rng(3)
    det = pd.DataFrame({"e": rng.integers(0, 4, 120), "t": rng.integers(0, 900, 120)}).drop_duplicates()
    tru = pd.DataFrame({"e": rng.integers(0, 4, 100), "t": rng.integers(0, 900, 100)}).drop_duplicates()
    got = metrics.greedy_matches(spark.createDataFrame(det), spark.createDataFrame(tru), ["e"], "t", 6).toPandas().set_index("e")
    for e in range(4):
        ts, used, tp = sorted(tru[tru.e == e].t), set(), 0
        for d in sorted(det[det.e == e].t):
            near = [(abs(d - x), i) for i, x in enumerate(ts) if i not in used and abs(d - x) <= 6]
            if near:
                used.add(min(near)[1])
                tp += 1
        n_det = (det.e == e).sum()
        assert tuple(got.loc[e]) == (tp, n_det - tp, len(ts) - tp)


def test_integrate_and_fire(spark, skewed):
    rows = skewed.sort_values(["k", "at", "id"]).assign(pos=lambda d: d.groupby("k").cumcount(), w=lambda d: d.v.abs())
    got = windows.integrate_and_fire(spark.createDataFrame(rows[["k", "pos", "w"]]), ["k"], "pos", "w", 3.0).toPandas()
    want = []
    for k, g in rows.groupby("k"):
        level = 0.0
        for p, s in zip(g.pos, g.w):
            level += s
            if level >= 3.0:
                want.append((k, p))
                level = 0.0
    assert sorted(map(tuple, got[["k", "pos"]].to_numpy().tolist())) == sorted(want)


def test_bootstrap_weights_are_poisson(spark):
    u = spark.range(20000).select(metrics.poisson_weight(metrics.uniform(F.col("id"))).alias("w"))
    m = u.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert abs(m["m"] - 1) < 0.03 and abs(m["v"] - 1) < 0.06




def test_a_stored_index_serves_many_searches_and_grows(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 4)) * 100
    x = np.concatenate([centres[i % 6] + rng.normal(size=4) for i in range(240)]).reshape(-1, 4).round(3)

    def table(rows):
        return spark.createDataFrame(pd.DataFrame({"id": rows, "vector": [list(v) for v in x[rows]], "y": rows % 3, "ep": rows % 5}))

    first, later, last = np.arange(0, 120), np.arange(120, 200), np.arange(200, 240)
    index = neighbors.NeighbourIndex.build(table(first), f"{tmp_path}/index", payload=["y"], mask="ep", pivots=12, block_rows=15)

    def check(rows, asked, mask):
        got = index.search(table(asked), 4, mask).toPandas()
        d = np.sqrt(((x[asked][:, None] - x[rows][None]) ** 2).sum(-1))
        if mask:
            d[(asked % 5)[:, None] == (rows % 5)[None]] = np.inf
        for i, q in enumerate(asked):
            mine = got[got.qid == q].sort_values("rank")
            assert np.allclose(mine.distance, np.sort(d[i])[:4], atol=1e-4) and (mine.y == mine.id % 3).all()

    check(first, np.arange(0, 240, 7), "ep")
    check(first, np.arange(3, 60), None)
    index.append(table(later), "ep")
    index.append(table(last), "ep")
    check(np.arange(240), np.arange(0, 240, 3), "ep")
    near_one = np.array([k for k in range(240) if k % 6 == 2])  # one cluster of six
    found = index.visits(table(near_one), 4, None).select("bin").distinct().count()
    assert found < index.cells().select("bin").distinct().count()
    plan = index.search(table(near_one), 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bin" in plan or "PartitionFilters: [bin" in plan
    empty = neighbors.NeighbourIndex.build(table(first).limit(0), f"{tmp_path}/empty", payload=["y"])
    assert empty.search(table(first), 3).count() == 0
    assert index.search(table(first).limit(0), 3).count() == 0


def test_a_unit_of_neighbours_keeps_the_smallest_ids(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neighbors, "TILE", (7, 13))
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (150, 3)).astype(float)  # many copies and ties
    ep = [None if i % 11 == 0 else str(i % 3) for i in range(150)]
    xs = pa.table({"id": rng.permutation(150), "vec": list(x), "m": ep, "at": (np.arange(150) % 3).astype("int32"), "y": np.arange(150)})
    wanted = [[0, 1, 2] if i % 2 else [1] for i in range(40)]
    qs = pa.table({"id": np.arange(40), "vec": list(x[:40]), "m": ep[:40], "blocks": pa.array(wanted, pa.list_(pa.int32()))})
    for masked in (False, True):
        got = neighbors.nearest_of(qs, xs, 5, masked, ["y"]).to_pylist()
        for q, r in enumerate(got):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            want = sorted((d[i], xs["id"][i].as_py(), i) for i in range(150) if i % 3 in wanted[q] and not (masked and ep[i] == ep[q]))[:5]
            assert r["qid"] == q and [(n["id"], n["y"]) for n in r["near"]] == [w[1:] for w in want]
            assert [n["distance"] for n in r["near"]] == pytest.approx([w[0] for w in want])


def test_the_spread_is_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    stats = spark.range(50).select((F.col("id") / 100).alias("x")).select(F.udf(seen, "double")("x").alias("sigma"))
    out = neighbors.spread_summary(stats, 0.5).first()
    assert (out["n"], round(out["median"], 3)) == (50, 0.245) and calls.value == 50


def test_ranges_of_a_hot_key_are_not_dealt_by_the_key(spark, tight):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(200).select(F.lit("a").alias("k"), F.col("id").alias("at"))
        out = ordered.running(df, ["k"], "at", {"n": ordered.rcount()})
        assert out.filter("n <> at + 1").count() == 0 and out.count() == 200
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counted_sizes_give_the_edges_of_their_rows(spark):
    rows = spark.createDataFrame([(k, float(v)) for k in "ab" for v in (1, 2, 2, 3, 5, 5, 5, 8, 9, 13)] + [("a", None), (None, 4.0)], "k string, v double")
    counted = ordered.value_counts(rows, ["k"], "v", "n_rows")
    plain, paired = (metrics.displacement_edges(r, "v", 2.0, ["k"], c) for r, c in ((rows, None), (counted, "n_rows")))
    assert sorted(map(str, plain.collect())) == sorted(map(str, paired.select(*plain.columns).collect()))
    a = plain.filter("k = 'a'").first()
    assert (a["n"], a["q3"], a["still_share"], a["top_median"]) == (9, 5.0, 0.1, 11.0)
