"""Nearest-neighbour and within-frame pair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import neighbors, pairs, splits
from tickloom.plans.registry import Tables, query

EMB = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, (label >= 5)::INT AS y, vec_id % 25 AS ep FROM embeddings)"""
RANKED = """p AS (SELECT q.id AS qid, x.id, list_cosine_similarity(q.v, x.v) AS s, x.y, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.id) AS r FROM e q, e x WHERE {cond})"""


def vectors(t: Tables):
    return t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") >= 5).cast("int").alias("y"), (F.col("vec_id") % 25).alias("ep"), F.slice("embedding", 1, 5).alias("action")
    )


SIGMA = """SELECT qid, count(*) AS n, round(avg(y), 8) AS mean, round(stddev_pop(y), 8) AS sigma FROM p WHERE r <= 32 GROUP BY 1"""


@query("neighbor_sigma", "J17 A19", f"WITH {EMB}, {RANKED.format(cond='q.id <> x.id')} {SIGMA}")
def neighbor_sigma(t: Tables):
    return sigma(t, "id")


@query("neighbor_sigma_masked", "J17 A19", f"WITH {EMB}, {RANKED.format(cond='q.ep <> x.ep')} {SIGMA}")
def neighbor_sigma_masked(t: Tables):
    return sigma(t, "ep")


def sigma(t: Tables, mask: str):
    v = vectors(t)
    near = neighbors.knn(v, v, 32, metric="cosine", mask=mask, payload=["y"])
    out = neighbors.outcome_stats(near, "y")
    return out.select("qid", "n", F.round("mean", 8).alias("mean"), F.round("sigma", 8).alias("sigma"))


@query(
    "spread_summary",
    "A19",
    f"""WITH {EMB}, {RANKED.format(cond='q.ep <> x.ep')}, s AS (SELECT qid, stddev_pop(y) AS s FROM p WHERE r <= 32 GROUP BY 1)
    SELECT count(*) AS n, round(quantile_cont(s, 0.5), 8) AS median, round(avg((s BETWEEN 0.15 AND 0.45)::INT), 8) AS in_band, round(avg((s > 0.45)::INT), 8) AS above, CASE WHEN quantile_cont(s, 0.5) < 0.15 THEN 'collapse' WHEN quantile_cont(s, 0.5) > 0.45 THEN 'random' ELSE 'pass' END AS verdict FROM s""",
)
def spread_summary(t: Tables):
    v = vectors(t)
    near = neighbors.knn(v, v, 32, metric="cosine", mask="ep", payload=["y"])
    rate = v.agg(F.avg("y")).first()[0]
    out = neighbors.spread_summary(neighbors.outcome_stats(near, "y"), rate)
    return out.select("n", *[F.round(c, 8).alias(c) for c in ("median", "in_band", "above")], "verdict")


@query(
    "knn_split",
    "J17 U6",
    f"""WITH {EMB}, h AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(sha256(id || '#2'), 1, 13))::BIGINT, id) AS r, count(*) OVER () AS n FROM e), w AS (SELECT *, r > floor(n * (1 - 0.1::DOUBLE)) AS val FROM h),
    p AS (SELECT q.id AS qid, x.id, list_cosine_similarity(q.v, x.v) AS s, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.id) AS r FROM w q, w x WHERE q.val AND NOT x.val)
    SELECT qid, id, r AS rank, round(s, 7) AS cosine FROM p WHERE r <= 5""",
)
def knn_split(t: Tables):
    marked = splits.group_split(vectors(t), "id", 0.1, seed=2)
    near = neighbors.knn(marked.filter("split = 'val'"), marked.filter("split = 'train'"), 5, metric="cosine")
    return near.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round(1 - F.col("distance") ** 2 / 2, 7).alias("cosine"))


VALUE = f"""{EMB.replace("vec_id % 25 AS ep", "vec_id % 25 AS ep, embedding[1:5]::DOUBLE[] AS a")}, p AS (SELECT q.id AS qid, q.a AS qa, x.a, x.y, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, x.v), x.id) AS r FROM e q, e x WHERE q.ep <> x.ep),
    c AS (SELECT *, list_cosine_similarity(a, qa) AS cos FROM p WHERE r <= 32), g AS (SELECT qid, count(*) AS n, count(*) FILTER (cos > 0.5) AS matched, avg(y) AS v, avg(y) FILTER (cos > 0.5) AS q, min(cos) AS cos_min, max(cos) AS cos_max, avg(cos) AS cos_mean, stddev_pop(y) AS sd FROM c GROUP BY 1)"""


@query(
    "state_action_value",
    "J16 A20 E2",
    f"""WITH {VALUE} SELECT qid, n, matched, round(v, 8) AS v, round(coalesce(q, v), 8) AS q, round(CASE WHEN matched >= 5 THEN q - v ELSE 0 END, 8) AS advantage FROM g""",
)
def state_action_value(t: Tables):
    return valued(t).select("qid", "n", "matched", *[F.round(c, 8).alias(c) for c in ("v", "q", "advantage")])


@query(
    "neighbor_diagnostics",
    "A40",
    f"""WITH {VALUE} SELECT qid, matched >= 5 AS confident, round(cos_min, 7) AS cos_min, round(cos_max, 7) AS cos_max, round(cos_mean, 7) AS cos_mean, round(sd, 8) AS outcome_std FROM g""",
)
def neighbor_diagnostics(t: Tables):
    return valued(t).select("qid", "confident", *[F.round(c, 7).alias(c) for c in ("cos_min", "cos_max", "cos_mean")], F.round("outcome_std", 8).alias("outcome_std"))


def valued(t: Tables):
    v = vectors(t)
    near = neighbors.knn(v, v, 32, mask="ep", payload=["y", "action"])
    return neighbors.values(near, v, "y", "action")


# Orders as frames: the line number is the slot, four slots per side.
BOARD = """b AS (SELECT l_orderkey AS f, l_linenumber - 1 AS s, max({'x': l_extendedprice / 20, 'y': l_partkey * 2.0::DOUBLE, 'dx': cos(l_suppkey), 'dy': sin(l_suppkey), 'alive': l_returnflag <> 'R'}) AS p FROM lineitem GROUP BY 1, 2),
    pl AS (SELECT f, s, s // 4 AS side, p.x AS x, p.y AS y, p.dx AS dx, p.dy AS dy, p.alive AS alive FROM b)"""


def board(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("f"), (F.col("l_linenumber") - 1).alias("s"), (F.col("l_extendedprice") / 20).alias("x"), (F.col("l_partkey") * 2.0).alias("y"),
        F.cos("l_suppkey").alias("dir_x"), F.sin("l_suppkey").alias("dir_y"), (F.col("l_returnflag") != "R").alias("alive"),
    )


@query(
    "pairwise_entity_features",
    "J18",
    f"""WITH {BOARD}, j AS (SELECT a.f, a.s, a.alive AS me, b.s AS o, b.side <> a.side AS foe, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, (a.dx * (b.x - a.x) + a.dy * (b.y - a.y)) AS dm, (b.dx * (a.x - b.x) + b.dy * (a.y - b.y)) AS dt FROM pl a LEFT JOIN pl b ON a.f = b.f AND a.s <> b.s AND b.alive AND a.alive),
    k AS (SELECT *, foe AND d <= 3500 AS see, dm / CASE WHEN d = 0 THEN 1 ELSE d END AS m, dt / CASE WHEN d = 0 THEN 1 ELSE d END AS t FROM j)
    SELECT f AS frame, s::BIGINT AS slot, round(CASE WHEN any_value(me) THEN coalesce(min(d) FILTER (foe), 3000) / 3000 ELSE 0 END, 7) AS near_enemy, round(CASE WHEN any_value(me) THEN coalesce(min(d) FILTER (NOT foe), 3000) / 3000 ELSE 0 END, 7) AS near_mate,
      round(count(*) FILTER (see) / 4.0, 7) AS n_visible, round(count(*) FILTER (see AND m > cos(radians(53))) / 4.0, 7) AS n_in_view, round(count(*) FILTER (see AND t > cos(radians(53))) / 4.0, 7) AS n_aiming,
      round(CASE WHEN NOT any_value(me) THEN 0 WHEN count(*) FILTER (see) > 0 THEN acos(least(greatest(max(m) FILTER (see), -1), 1)) / pi() ELSE 1 END, 6) AS aim_error FROM k GROUP BY 1, 2""",
)
def pairwise_entity_features(t: Tables):
    out = pairs.perception(board(t), ["f"], "s", per_side=4)
    return out.select(
        F.col("f").alias("frame"), F.col("slot").cast("long").alias("slot"), *[F.round(c, 7).alias(c) for c in ("near_enemy", "near_mate", "n_visible", "n_in_view", "n_aiming")], F.round("aim_error", 6).alias("aim_error")
    )


@query(
    "nearest_living",
    "J20 P7",
    f"""WITH {BOARD} SELECT f AS frame, coalesce(arg_min(s, ((x - 2500) ** 2 + (y - 2000) ** 2, s)) FILTER (alive), -1)::BIGINT AS slot FROM pl GROUP BY 1""",
)
def nearest_living(t: Tables):
    players = pairs.slots_to_row(board(t), ["f"], "s", ["x", "y", "dir_x", "dir_y", "alive"], 7)
    long = players.select("f", F.posexplode("slots").alias("s", "p")).filter("p IS NOT NULL").select("f", "s", "p.*")
    out = pairs.nearest_living(long, ["f"], "s", "x", F.lit(2500.0), F.lit(2000.0))
    return out.select(F.col("f").alias("frame"), F.coalesce("slot", F.lit(-1)).cast("long").alias("slot"))


WALLS = """w AS (SELECT DISTINCT s_suppkey * 50.0::DOUBLE AS ox0, (s_suppkey * 37 % 100) * 40.0::DOUBLE AS oy0, s_suppkey * 50.0::DOUBLE + (s_suppkey % 7 - 3) * 60 AS ox1, (s_suppkey * 37 % 100) * 40.0::DOUBLE + 150 AS oy1 FROM supplier)"""


@query(
    "sight_lines",
    "J19",
    f"""WITH {BOARD}, {WALLS}, l AS (SELECT a.f, a.s AS sa, b.s AS sb, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM pl a JOIN pl b ON a.f = b.f AND a.side < b.side AND a.alive AND b.alive WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3500)
    SELECT f AS frame, sa::BIGINT AS slot_a, sb::BIGINT AS slot_b FROM l WHERE NOT EXISTS (SELECT 1 FROM w WHERE
      ((x1 - x0) * (oy0 - y0) - (y1 - y0) * (ox0 - x0)) * ((x1 - x0) * (oy1 - y0) - (y1 - y0) * (ox1 - x0)) < 0 AND ((ox1 - ox0) * (y0 - oy0) - (oy1 - oy0) * (x0 - ox0)) * ((ox1 - ox0) * (y1 - oy0) - (oy1 - oy0) * (x1 - ox0)) < 0)""",
)
def sight_lines(t: Tables):
    k = F.col("s_suppkey")
    y = (k * 37 % 100) * 40.0
    walls = t.supplier.select((k * 50.0).alias("ox0"), y.alias("oy0"), (k * 50.0 + (k % 7 - 3) * 60).alias("ox1"), (y + 150).alias("oy1"))
    out = pairs.sight_lines(board(t), ["f"], "s", walls, per_side=4)
    return out.select(F.col("f").alias("frame"), F.col("slot_a").cast("long").alias("slot_a"), F.col("slot_b").cast("long").alias("slot_b"))


GRAMS = "CASE WHEN length({c}) >= 3 THEN list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) WHEN length({c}) > 0 THEN [{c}] ELSE [] END"


@query(
    "pair_filter_rank",
    "J13 F11 P37 P38 T1",
    f"""WITH r AS (SELECT p_partkey AS k, [p_name || ' ' || p_type, p_name || ' ' || lower(p_type), p_brand || ' ' || p_name] AS x, [CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size / 50 END, CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size / 50 END, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice / 3000 END]::DOUBLE[] AS w FROM part),
    p AS (SELECT k, i, j, x[i] AS a, x[j] AS b, w[i] AS ra, w[j] AS rb FROM r, (SELECT unnest([1, 1, 2]) AS i, unnest([2, 3, 3]) AS j)), g AS (SELECT *, {GRAMS.format(c='a')} AS ga, {GRAMS.format(c='b')} AS gb FROM p),
    s AS (SELECT *, len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) AS sim, coalesce(abs(ra - rb), 1) AS gap FROM g)
    SELECT k || '_' || (i - 1) || '_' || (j - 1) AS pair_id, round(0.5 * (1 - least(gap, 1)) + 0.5 * (1 - sim), 6) AS informativeness FROM s WHERE NOT coalesce(ra = 0 AND rb = 0, false) AND NOT (gap < 0.02 AND sim > 0.95)
    ORDER BY informativeness DESC, sha1(pair_id) LIMIT 500""",
)
def pair_filter_rank(t: Tables):
    size = F.col("p_size")

    def cand(txt, reward):
        return F.struct(txt.alias("text"), reward.cast("double").alias("reward"))

    items = F.array(
        cand(F.concat_ws(" ", "p_name", "p_type"), F.when(size % 3 == 0, 0).otherwise(size / 50)),
        cand(F.concat_ws(" ", "p_name", F.lower("p_type")), F.when(size % 2 == 0, 0).otherwise(size / 50)),
        cand(F.concat_ws(" ", "p_brand", "p_name"), F.when(size % 5 != 0, F.col("p_retailprice") / 3000)),
    )
    # the table is small beside the work on a row, so it is dealt to all cores
    dealt = t.part.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = dealt.select(F.col("p_partkey").alias("k"), items.alias("items"))
    good = pairs.informative_pairs(pairs.record_pairs(rows, "items", ["k"]))
    named = good.select(F.concat_ws("_", "k", "i", "j").alias("pair_id"), "informativeness")
    return splits.top_by_score(named, "informativeness", F.col("pair_id"), 500)


@query(
    "text_trigrams",
    "P37",
    f"""WITH g AS (SELECT doc_id, {GRAMS.format(c='text')} AS g FROM documents) SELECT doc_id, len(g)::BIGINT AS n FROM g""",
)
def text_trigrams(t: Tables):
    return t.documents.select("doc_id", F.size(text.trigrams(F.col("text"))).cast("long").alias("n"))
