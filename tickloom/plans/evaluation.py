"""Metric queries on prices, activity, embeddings and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import encode
from tickloom.functions import vocab as V
from tickloom.operators import metrics, ordered, quality, sketches, windows
from tickloom.plans.registry import ACTIVITY, Tables, query
from tickloom.plans.sequences import ID, USER, W, is_type, positions
from tickloom.session import scratch, stored

HOUR = 3_600_000_000


@query(
    "quantile_edges",
    "A5",
    """WITH m AS (SELECT 'ALL' AS flag, l_extendedprice AS v FROM lineitem UNION ALL SELECT l_returnflag, l_extendedprice FROM lineitem), e AS (SELECT flag, count(*) AS n, quantile_cont(v, [1/6, 2/6, 3/6, 4/6, 5/6]) AS q FROM m WHERE v >= 2000 GROUP BY 1)
    SELECT e.flag, any_value(e.n) AS n, round(any_value(q[1]), 5) AS q1, round(any_value(q[3]), 5) AS q3, round(any_value(q[5]), 5) AS q5, round(count(*) FILTER (v < 2000) / count(*), 8) AS still_share, round(quantile_cont(v, 0.5) FILTER (v >= q[5]), 5) AS top_median
    FROM e JOIN m USING (flag) GROUP BY e.flag""",
)
def quantile_edges(t: Tables):
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    counted = stored(ordered.value_counts(rows, ["flag"], "v", "rows"), "prices")
    per = metrics.displacement_edges(counted, "v", 2000.0, ["flag"], "rows")
    whole = metrics.displacement_edges(counted.groupBy("v").agg(F.sum("rows").alias("rows")), "v", 2000.0, count="rows").withColumn("flag", F.lit("ALL"))
    out = per.unionByName(whole)
    return out.select("flag", "n", *[F.round(c, 5).alias(c) for c in ("q1", "q3", "q5", "top_median")], F.round("still_share", 8).alias("still_share"))


@query(
    "quantile_methods",
    "A13 A8",
    """WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, max(n) AS n, max(n_chars) FILTER (r = round_even(0.9::DOUBLE * n - 0.9, 0)) AS p90, max(n_chars) FILTER (r = (n - 1) // 2) AS lower_median FROM s GROUP BY 1""",
)
def quantile_methods(t: Tables):
    near = ordered.quantiles(t.documents, ["lang"], "n_chars", {"p90": 0.9}, method="nearest")
    low = ordered.quantiles(t.documents, ["lang"], "n_chars", {"lower_median": 0.5}, method="lower").drop("n")
    return near.join(low, "lang")


@query(
    "least_squares_alpha",
    "A6",
    """SELECT l_returnflag AS flag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity), 6) AS alpha, count(*) AS n FROM lineitem GROUP BY 1""",
)
def least_squares_alpha(t: Tables):
    rows = t.lineitem.withColumnRenamed("l_returnflag", "flag")
    out = metrics.least_squares_alpha(rows, [F.col("l_extendedprice")], [F.col("l_quantity")], ["flag"])
    return out.withColumn("alpha", F.round("alpha", 6))


SKILL = f"""d AS (SELECT *, lead(value, 8) {W} - value AS d, value - lag(value) {W} AS v, (value - lag(value, 4) {W}) / 4 AS vs FROM activity),
    e AS (SELECT event_type, CASE WHEN abs(vs) < 5 AND abs(d) < 25 THEN 0 WHEN vs * d > 0 THEN 1 WHEN vs * d < 0 THEN 4 ELSE 3 END AS bucket, abs(d) AS "copy", abs(d - 8 * v) AS const_vel, abs(d - 8 * vs) AS smooth, abs(d - 0.5 * vs) AS model FROM d WHERE d IS NOT NULL AND vs IS NOT NULL)"""


def skill_rows(t: Tables):
    d = windows.displacement(t.activity, USER, "us", ["value"], 8, tie=ID).filter("d_value IS NOT NULL AND vs_value IS NOT NULL")
    d_, v, vs = F.col("d_value"), F.col("v_value"), F.col("vs_value")
    zero = F.lit(0.0)
    bucket = encode.turn_bucket(F.abs(vs), F.abs(d_), encode.angle_between(vs, zero, d_, zero))
    errors = {"copy": F.abs(d_), "const_vel": F.abs(d_ - 8 * v), "smooth": F.abs(d_ - 8 * vs), "model": F.abs(d_ - 0.5 * vs)}
    return d.select("event_type", bucket.cast("long").alias("bucket"), *[e.alias(n) for n, e in errors.items()])


@query(
    "bucketed_skill",
    "A7 P23",
    f"""WITH {ACTIVITY}, {SKILL}, g AS (SELECT bucket, count(*) AS n, avg("copy") AS c, avg(const_vel) AS k, avg(smooth) AS s, avg(model) AS m FROM e GROUP BY 1)
    SELECT bucket::BIGINT AS bucket, n, round(m, 6) AS model, CASE least(c, k, s) WHEN c THEN 'copy' WHEN k THEN 'const_vel' ELSE 'smooth' END AS best_baseline, CASE WHEN least(c, k, s) > 0 THEN round((least(c, k, s) - m) / least(c, k, s) * 100, 6) ELSE 0 END AS skill_pct FROM g""",
)
def bucketed_skill(t: Tables):
    out = metrics.bucketed_skill(skill_rows(t), ["bucket"], ["copy", "const_vel", "smooth"], "model")
    return out.select("bucket", "n", F.round("model", 6).alias("model"), "best_baseline", F.round("skill_pct", 6).alias("skill_pct"))


@query(
    "huber_by_group",
    "A9 A10",
    f"""WITH {ACTIVITY}, {SKILL} SELECT event_type, count(*) AS n, round(avg(CASE WHEN model / 50 < 1 THEN 0.5 * (model / 50) ** 2 ELSE model / 50 - 0.5 END), 8) AS model, round(avg(CASE WHEN "copy" / 50 < 1 THEN 0.5 * ("copy" / 50) ** 2 ELSE "copy" / 50 - 0.5 END), 8) AS "copy" FROM e GROUP BY 1""",
)
def huber_by_group(t: Tables):
    out = metrics.error_by(skill_rows(t), ["event_type"], {c: metrics.huber(F.col(c) / 50) for c in ("model", "copy")})
    return out.select("event_type", "n", F.round("model", 8).alias("model"), F.round("copy", 8).alias("copy"))


@query(
    "error_by_depth",
    "A10",
    f"""WITH {ACTIVITY}, p AS (SELECT *, {', '.join(f'lead(value, {k}) {W} AS f{k}' for k in (1, 2, 4, 8))}, value - lag(value) {W} AS v FROM activity),
    l AS (SELECT value, v, unnest([1, 2, 4, 8]) AS depth, unnest([f1, f2, f4, f8]) AS f FROM p WHERE v IS NOT NULL)
    SELECT depth::BIGINT AS depth, count(*) AS n, round(avg(abs(f - value)), 6) AS copy_error, round(avg(abs(f - value - depth * v)), 6) AS extrapolated FROM l WHERE f IS NOT NULL GROUP BY 1""",
)
def error_by_depth(t: Tables):
    depths = (1, 2, 4, 8)

    def ahead(w):
        return {f"f{k}": F.lead("value", k).over(w) for k in depths} | {"v": F.col("value") - F.lag("value").over(w)}

    rows = ordered.framed(t.activity, USER, "us", ahead, before=1, after=8, tie=ID).filter("v IS NOT NULL")
    long = rows.select("value", "v", F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("depth"), F.col(f"f{k}").alias("f")) for k in depths]))).filter("f IS NOT NULL")
    gap = F.col("f") - F.col("value")
    out = metrics.error_by(long, ["depth"], {"copy_error": F.abs(gap), "extrapolated": F.abs(gap - F.col("depth") * F.col("v"))})
    return out.select("depth", "n", F.round("copy_error", 6).alias("copy_error"), F.round("extrapolated", 6).alias("extrapolated"))


@query(
    "min_median_k",
    "A8",
    """WITH e AS (SELECT l_returnflag AS flag, abs(l_extendedprice - 50000) AS c, list_sort([abs(l_extendedprice - l_quantity * 900), abs(l_extendedprice - l_quantity * 1500), abs(l_extendedprice - l_quantity * 2100), abs(l_extendedprice - l_partkey * 20)]) AS errs FROM lineitem)
    SELECT flag, count(*) AS n, round(avg(c), 5) AS "copy", round(avg(errs[1]), 5) AS min_k, round(avg(errs[2]), 5) AS median_k, round((avg(c) - avg(errs[1])) / avg(c) * 100, 6) AS cover_pct FROM e GROUP BY 1""",
)
def min_median_k(t: Tables):
    price = F.col("l_extendedprice")
    guesses = [F.col("l_quantity") * 900, F.col("l_quantity") * 1500, F.col("l_quantity") * 2100, (F.col("l_partkey") * 20).cast("double")]
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.abs(price - 50000).alias("c"), F.array(*[F.abs(price - g) for g in guesses]).alias("errs"))
    out = metrics.min_median_k(rows, "errs", "c", ["flag"])
    return out.select("flag", "n", *[F.round(c, 5).alias(c) for c in ("copy", "min_k", "median_k")], F.round("cover_pct", 6).alias("cover_pct"))


@query(
    "auc_by_group",
    "A11",
    """WITH j AS (SELECT lang, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS rk FROM j)
    SELECT lang, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, coalesce(round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 8), -1)::DOUBLE AS auc FROM r GROUP BY 1""",
)
def auc_by_group(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").select("lang", "n_chars", "quality")
    out = metrics.auc(rows, ["lang"], "n_chars", "quality")
    return out.withColumn("auc", F.coalesce(F.round("auc", 8), F.lit(-1.0)))


@query(
    "auc_ordinal",
    "A11",
    """WITH r AS (SELECT l_linestatus AS g, (l_returnflag = 'R')::INT AS y, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rk FROM lineitem)
    SELECT g, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS auc FROM r GROUP BY 1""",
)
def auc_ordinal(t: Tables):
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = t.lineitem.select(F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", *tie)
    return metrics.auc(rows, ["g"], "l_quantity", "y", ties="ordinal", tie=tie).withColumn("auc", F.round("auc", 8))


PRICED = """c AS (SELECT p_brand, l_extendedprice AS a, p_retailprice * l_quantity AS b, p_retailprice * 25 AS c, 50000.0::DOUBLE AS d FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def priced(t: Tables):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select("p_brand", F.col("l_extendedprice").alias("a"), (F.col("p_retailprice") * F.col("l_quantity")).alias("b"), (F.col("p_retailprice") * 25).alias("c"), F.lit(50000.0).alias("d"))


@query(
    "pairwise_auc",
    "A12 E3",
    f"""WITH {PRICED}, w AS (SELECT p_brand, {', '.join(f'CASE WHEN a > {o} THEN 1.0 WHEN a = {o} THEN 0.5 ELSE 0 END::DOUBLE AS w{o}' for o in 'bcd')} FROM c)
    SELECT p_brand, count(*) AS n, round(avg(wb), 8) AS beats_b, round(avg(wc), 8) AS beats_c, round(avg(wd), 8) AS beats_d, round((avg(wb) + avg(wc) + avg(wd)) / 3, 8) AS auc FROM w GROUP BY 1""",
)
def pairwise_auc(t: Tables):
    out = metrics.pairwise_auc(priced(t), "a", ["b", "c", "d"], ["p_brand"])
    return out.select("p_brand", "n", *[F.round(c, 8).alias(c) for c in ("beats_b", "beats_c", "beats_d", "auc")])


@query(
    "pairwise_failures",
    "A12",
    f"""WITH {PRICED} SELECT concat_ws(',', CASE WHEN a <= b THEN 'b' END, CASE WHEN a <= c THEN 'c' END, CASE WHEN a <= d THEN 'd' END) AS failed, count(*) AS n FROM c WHERE a <= b OR a <= c OR a <= d GROUP BY 1""",
)
def pairwise_failures(t: Tables):
    bad = metrics.not_beaten(priced(t), "a", ["b", "c", "d"])
    return bad.groupBy(F.array_join("failed_against", ",").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


DETECT = """det AS (SELECT user_id, us FROM activity WHERE value > 60), tru AS (SELECT user_id, us FROM activity WHERE event_type IN ('error', 'click')),
    pb AS (SELECT d.user_id, d.us, t.us AS b FROM det d ASOF LEFT JOIN tru t ON d.user_id = t.user_id AND d.us >= t.us), pf AS (SELECT pb.*, t.us AS f FROM pb ASOF LEFT JOIN tru t ON pb.user_id = t.user_id AND pb.us <= t.us),
    rb AS (SELECT t.user_id, t.us, d.us AS b FROM tru t ASOF LEFT JOIN det d ON d.user_id = t.user_id AND t.us >= d.us), rf AS (SELECT rb.*, d.us AS f FROM rb ASOF LEFT JOIN det d ON d.user_id = rb.user_id AND rb.us <= d.us)"""


@query(
    "precision_recall_tol",
    "A13",
    f"""WITH {ACTIVITY}, {DETECT} SELECT 'precision' AS side, count(*) AS n, count(*) FILTER (least(us - b, f - us) <= {HOUR}) AS matched, round(count(*) FILTER (least(us - b, f - us) <= {HOUR}) / count(*), 8) AS rate FROM pf
    UNION ALL SELECT 'recall', count(*), count(*) FILTER (least(us - b, f - us) <= {HOUR}), round(count(*) FILTER (least(us - b, f - us) <= {HOUR}) / count(*), 8) FROM rf""",
)
def precision_recall_tol(t: Tables):
    det, tru = t.activity.filter("value > 60").select("user_id", "us"), t.activity.filter(F.col("event_type").isin("error", "click")).select("user_id", "us")
    return metrics.detection_quality(det, tru, USER, "us", HOUR).withColumn("rate", F.round("rate", 8))


@query(
    "match_deltas",
    "A13",
    f"""WITH {ACTIVITY}, {DETECT}, d AS (SELECT us - CASE WHEN f IS NULL OR us - b <= f - us THEN b ELSE f END AS delta FROM pf WHERE least(us - b, f - us) <= {8 * HOUR}),
    s AS (SELECT delta, row_number() OVER (ORDER BY delta) - 1 AS r, count(*) OVER () AS n FROM d) SELECT max(n) AS n, min(delta) AS lo, max(delta) AS hi, max(delta) FILTER (r = round_even(0.95::DOUBLE * n - 0.95, 0)) AS p95 FROM s""",
)
def match_deltas(t: Tables):
    det, tru = t.activity.filter("value > 60").select("user_id", "us"), t.activity.filter(F.col("event_type").isin("error", "click")).select("user_id", "us")
    deltas = metrics.match_deltas(det, tru, USER, "us", 8 * HOUR)
    return ordered.quantiles(deltas, [], "delta", {"lo": 0.0, "hi": 1.0, "p95": 0.95}, method="nearest")


# Each detection in order takes the nearest truth that is left; of equally near ones the earlier.
@query(
    "greedy_matches",
    "J21",
    f"""WITH RECURSIVE {ACTIVITY}, d AS (SELECT user_id, list(us ORDER BY us) AS ds FROM activity WHERE value > 60 GROUP BY 1), r AS (SELECT user_id, list(us ORDER BY us) AS ts FROM activity WHERE event_type IN ('error', 'click') GROUP BY 1),
    u AS (SELECT user_id, coalesce(ds, []) AS ds, coalesce(ts, []) AS ts FROM d FULL JOIN r USING (user_id)),
    w AS (SELECT user_id, ds, ts, 0 AS i, []::BIGINT[] AS used FROM u
      UNION ALL SELECT user_id, ds, ts, i + 1, CASE WHEN near IS NULL THEN used ELSE list_append(used, near.k) END FROM (
        SELECT *, list_sort(list_transform(list_filter(range(1, len(ts) + 1), lambda k: abs(ts[k] - ds[i + 1]) <= {4 * HOUR} AND NOT list_contains(used, k)), lambda k: {{'gap': abs(ts[k] - ds[i + 1]), 'k': k}}))[1] AS near FROM w WHERE i < len(ds)))
    SELECT user_id, len(used)::BIGINT AS tp, (len(ds) - len(used))::BIGINT AS fp, (len(ts) - len(used))::BIGINT AS fn FROM w WHERE i = len(ds)""",
)
def greedy_matches(t: Tables):
    det, tru = t.activity.filter("value > 60").select("user_id", "us"), t.activity.filter(F.col("event_type").isin("error", "click")).select("user_id", "us")
    return metrics.greedy_matches(det, tru, USER, "us", 4 * HOUR)


@query(
    "direction_follow",
    "A14",
    """WITH d AS (SELECT l_quantity - 25 AS tx, l_discount * 100 - 5 AS ty, cos(l_partkey) AS fx, sin(l_partkey) AS fy, l_tax * 100 - 4 AS vx, l_linenumber - 4 AS vy, l_extendedprice / 1000 - 50 AS px, l_suppkey % 11 - 5 AS py FROM lineitem),
    a AS (SELECT """
    + ", ".join(
        f"degrees(acos(least(greatest(({a}x * {b}x + {a}y * {b}y) / (sqrt({a}x ** 2 + {a}y ** 2) * sqrt({b}x ** 2 + {b}y ** 2) + 1e-9), -1), 1))) AS {a}{b}"
        for a, b in (("f", "v"), ("t", "f"), ("t", "v"), ("p", "f"), ("p", "v"))
    )
    + """ FROM d), c AS (SELECT count(*) AS n, count(*) FILTER (fv > 60) AS n_conflict, count(*) FILTER (fv > 60 AND tf < tv) AS truth_facing, count(*) FILTER (fv > 60 AND pf < pv) AS pred_facing FROM a)
    SELECT *, round(100 * pred_facing / n_conflict - 100 * truth_facing / n_conflict, 6) AS bias_pp FROM c""",
)
def direction_follow(t: Tables):
    c = F.col
    v = {"t": (c("l_quantity") - 25, c("l_discount") * 100 - 5), "f": (F.cos("l_partkey"), F.sin("l_partkey")), "v": (c("l_tax") * 100 - 4, c("l_linenumber") - 4), "p": (c("l_extendedprice") / 1000 - 50, c("l_suppkey") % 11 - 5)}

    def angle(a, b):
        return encode.angle_between(*v[a], *v[b])

    out = metrics.follow_counts(t.lineitem, angle("f", "v") > V.FOLLOW_CONFLICT_DEG, angle("t", "f") < angle("t", "v"), angle("p", "f") < angle("p", "v"))
    return out.withColumn("bias_pp", F.round("bias_pp", 6))


@query(
    "frame_surprise",
    "A15 A3",
    """SELECT l_orderkey AS k, coalesce(round(avg(l_extendedprice / 1000) FILTER (l_returnflag <> 'R'), 9), -1) AS surprise, count(*) FILTER (l_returnflag <> 'R') AS n_alive FROM lineitem GROUP BY 1""",
)
def frame_surprise(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_extendedprice") / 1000).alias("nll"), (F.col("l_returnflag") != "R").alias("alive"))
    return metrics.surprise(rows, ["k"], "nll", "alive").withColumn("surprise", F.coalesce(F.round("surprise", 9), F.lit(-1.0)))


@query(
    "alignment_lift",
    "A16 W19",
    f"""WITH {ACTIVITY}, p AS (SELECT *, row_number() {W} AS pos FROM activity), l AS (SELECT user_id, count(*) AS t FROM p GROUP BY 1),
    b AS (SELECT user_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, pos) AS r FROM p) JOIN l USING (user_id) WHERE r <= greatest(1, round_even(0.1::DOUBLE * t, 0))),
    k AS (SELECT user_id, count(*) AS k FROM b GROUP BY 1), e AS (SELECT user_id, pos FROM p WHERE event_type = 'error'),
    g AS (SELECT e.user_id, e.pos, min(abs(b.pos - e.pos)) AS gap FROM e LEFT JOIN b USING (user_id) GROUP BY 1, 2), w AS (SELECT unnest([2, 4, 8]) AS w),
    s AS (SELECT w, count(*) AS n_events, avg((gap <= w)::INT) AS a, avg(1 - (1 - least(1.0::DOUBLE, (2 * w + 1) / t)) ** k) AS r FROM g JOIN l USING (user_id) JOIN k USING (user_id) CROSS JOIN w GROUP BY 1)
    SELECT w::BIGINT AS "window", n_events, round(a, 8) AS align, round(r, 8) AS random, round(a - r, 8) AS lift FROM s""",
)
def alignment_lift(t: Tables):
    frames = positions(t)
    picks = windows.top_fraction(frames, USER, "value", 0.1, "pos")
    lengths = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("length"))
    out = metrics.alignment_lift(picks, frames.filter(is_type("error")), lengths, USER, "pos", [2, 4, 8])
    return out.select("window", "n_events", *[F.round(c, 8).alias(c) for c in ("align", "random", "lift")])


@query(
    "timing_errors",
    "A17",
    f"""WITH {ACTIVITY}, n AS (SELECT event_type, lead(event_type) {W} AS nt, value, lead(value) {W} AS nv FROM activity), e AS (SELECT event_type, event_type = nt AS correct, abs(value - nv) AS e FROM n WHERE nt IS NOT NULL)
    SELECT event_type, correct, count(*) AS n, round(quantile_cont(e, 0.25), 7) AS p25, round(quantile_cont(e, 0.5), 7) AS median, round(quantile_cont(e, 0.75), 7) AS p75 FROM e GROUP BY 1, 2""",
)
def timing_errors(t: Tables):
    def nxt(w):
        return {"nt": F.lead("event_type").over(w), "nv": F.lead("value").over(w)}

    rows = ordered.framed(t.activity, USER, "us", nxt, before=0, after=1, tie=ID).filter("nt IS NOT NULL")
    out = metrics.timing_errors(rows, "value", "nv", "event_type", "nt")
    return out.select("event_type", "correct", "n", *[F.round(c, 7).alias(c) for c in ("p25", "median", "p75")])


@query(
    "cluster_tightness",
    "A18",
    """WITH x AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), a AS (SELECT i, avg(v) AS m FROM x GROUP BY 1),
    d AS (SELECT vec_id, x.label, sqrt(sum((v - c.m) ** 2)) AS own, sqrt(sum((v - a.m) ** 2)) AS alld FROM x JOIN c ON c.label = x.label AND c.i = x.i JOIN a ON a.i = x.i GROUP BY 1, 2), g AS (SELECT label, avg(own) AS own, count(*) AS n FROM d GROUP BY 1)
    SELECT count(*) FILTER (n >= 3) AS classes, round(avg(own) FILTER (n >= 3) / (SELECT avg(alld) FROM d), 8) AS ratio FROM g""",
)
def cluster_tightness(t: Tables):
    return metrics.cluster_tightness(t.embeddings, "embedding", "label", 64).withColumn("ratio", F.round("ratio", 8))


@query(
    "group_advantage",
    "A24",
    """WITH g AS (SELECT l_orderkey AS k, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s, count(*) FILTER (l_discount > 0) AS passes FROM lineitem GROUP BY 1)
    SELECT k, l_linenumber::BIGINT AS n, round(l_extendedprice - m, 5) AS advantage, coalesce(s < 1e-8, false) AS skipped, passes FROM lineitem JOIN g ON k = l_orderkey""",
)
def group_advantage(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), "l_extendedprice", "l_discount")
    out = metrics.group_advantages(rows, ["k"], "l_extendedprice", F.col("l_discount") > 0)
    return out.select("k", "n", F.round("advantage", 5).alias("advantage"), "skipped", "passes")


@query(
    "spread_audit",
    "A25",
    """WITH g AS (SELECT l_orderkey, count(*) AS k, stddev_samp(l_discount) AS s FROM lineitem WHERE l_discount > 1e-6 GROUP BY 1 HAVING count(*) >= 2)
    SELECT k, count(*) AS n, round(quantile_cont(s, 0.25), 8) AS p25, round(quantile_cont(s, 0.5), 8) AS median, round(quantile_cont(s, 0.75), 8) AS p75, round(avg((s < 1e-4)::INT), 8) AS zero_share FROM g GROUP BY 1""",
)
def spread_audit(t: Tables):
    out = metrics.spread_audit(t.lineitem, ["l_orderkey"], "l_discount")
    return out.select("k", "n", *[F.round(c, 8).alias(c) for c in ("p25", "median", "p75", "zero_share")])


@query(
    "majority_baseline",
    "A26",
    """WITH j AS (SELECT lang, quality AS y, (n_chars > 1000)::INT AS p, 1 - toxic AS q FROM documents JOIN labels USING (doc_id)), g AS (SELECT lang, count(*) AS n, greatest(avg(y), 1 - avg(y)) AS m, avg((y = p)::INT) AS a, avg((y = q)::INT) AS b FROM j GROUP BY 1)
    SELECT lang, n, round(m, 8) AS majority, round(a, 8) AS acc_long, round(b, 8) AS acc_clean, round(a - m, 8) AS gap_long FROM g""",
)
def majority_baseline(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").select("lang", "quality", (F.col("n_chars") > 1000).cast("int").alias("long"), (1 - F.col("toxic")).alias("clean"))
    out = metrics.majority_baseline(rows, "quality", ["long", "clean"], ["lang"])
    return out.select("lang", "n", *[F.round(c, 8).alias(c) for c in ("majority", "acc_long", "acc_clean", "gap_long")])


@query(
    "variance_explained",
    "A27",
    """SELECT l_returnflag AS flag, count(*) AS n, round(1 - sum((l_quantity * 2100 - l_extendedprice) ** 2) / (var_pop(l_extendedprice) * count(*)), 8) AS fve FROM lineitem GROUP BY 1""",
)
def variance_explained(t: Tables):
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_extendedprice", (F.col("l_quantity") * 2100).alias("guess"))
    return metrics.variance_explained(rows, "l_extendedprice", "guess", ["flag"]).withColumn("fve", F.round("fve", 8))


def _poisson_sql(u: str) -> str:
    import math

    total, term, parts = 0.0, math.exp(-1), []
    for n in range(1, 9):
        total += term
        parts.append(f"({u} >= {total!r}::DOUBLE)::INT")
        term /= n
    return " + ".join(parts)


@query(
    "bootstrap_ci",
    "A35",
    f"""WITH c AS (SELECT l_returnflag || l_linestatus || l_linenumber AS c, sum(abs(l_extendedprice - l_quantity * 2000) - abs(l_extendedprice - 50000)) AS d, count(*) AS n FROM lineitem GROUP BY 1),
    w AS (SELECT *, ('0x' || substr(sha256(c || '#' || b || '#4'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM c, (SELECT unnest(range(1, 401)) AS b)),
    m AS (SELECT b, sum(({_poisson_sql('u')}) * d) / sum(({_poisson_sql('u')}) * n) AS x FROM w GROUP BY 1)
    SELECT count(*) AS n, round(quantile_cont(x, 0.025), 5) AS low, round(quantile_cont(x, 0.5), 5) AS median, round(quantile_cont(x, 0.975), 5) AS high FROM m""",
)
def bootstrap_ci(t: Tables):
    rows = t.lineitem.select(
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("c"),
        F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 2000).alias("model"), F.abs(F.col("l_extendedprice") - 50000).alias("base"),
    )
    out = metrics.cluster_bootstrap(rows, "c", "model", "base", 400, seed=4)
    return out.select("n", *[F.round(c, 5).alias(c) for c in ("low", "median", "high")])


@query(
    "crps_brier",
    "A41",
    """WITH e AS (SELECT l_returnflag AS flag, l_extendedprice / 1000 AS y, list_sort([l_quantity * 0.9, l_quantity * 1.5, l_quantity * 2.1, l_partkey / 50]) AS x, l_discount * 10 AS p, (l_linestatus = 'O')::INT AS o FROM lineitem),
    s AS (SELECT flag, (abs(x[1] - y) + abs(x[2] - y) + abs(x[3] - y) + abs(x[4] - y)) / 4 - (-3 * x[1] - x[2] + x[3] + 3 * x[4]) / 16 AS crps, (p - o) ** 2 AS brier FROM e) SELECT flag, count(*) AS n, round(avg(crps), 8) AS crps, round(avg(brier), 8) AS brier FROM s GROUP BY 1""",
)
def crps_brier(t: Tables):
    q = F.col("l_quantity")
    samples = F.array(q * 0.9, q * 1.5, q * 2.1, F.col("l_partkey") / 50)
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("flag"), metrics.crps(samples, F.col("l_extendedprice") / 1000).alias("crps"),
        metrics.brier(F.col("l_discount") * 10, (F.col("l_linestatus") == "O").cast("int")).alias("brier"),
    )
    return rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("crps"), 8).alias("crps"), F.round(F.avg("brier"), 8).alias("brier"))


@query(
    "intraclass_correlation",
    "A41",
    """WITH g AS (SELECT l_orderkey, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1), s AS (SELECT count(*) AS g, sum(n)::BIGINT AS n, sum(n * v) AS ssw, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb FROM g)
    SELECT g AS groups, n, round((ssb / (g - 1) - ssw / (n - g)) / (ssb / (g - 1) + (n / g - 1) * ssw / (n - g)), 7) AS icc FROM s""",
)
def intraclass_correlation(t: Tables):
    return metrics.intraclass_correlation(t.lineitem, ["l_orderkey"], "l_extendedprice").withColumn("icc", F.round("icc", 7))


REV = "AS (SELECT user_id, count(*) FILTER ((value - p1) * (p1 - p2) < 0) AS n FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS p1, lag(value, 2) OVER (PARTITION BY user_id ORDER BY pos) AS p2 FROM {src}) GROUP BY 1)"


@query(
    "downsampling_loss",
    "A42",
    f"""WITH {ACTIVITY}, p AS (SELECT *, row_number() {W} AS pos FROM activity), q AS (SELECT * FROM p WHERE (pos - 1) % 4 = 0), f {REV.format(src='p')}, k {REV.format(src='q')}
    SELECT f.user_id, f.n AS "full", coalesce(k.n, 0) AS kept, coalesce(round(CASE WHEN f.n > 0 THEN 1 - least(coalesce(k.n, 0), f.n) / f.n END, 8), -1) AS lost_share FROM f LEFT JOIN k USING (user_id)""",
)
def downsampling_loss(t: Tables):
    out = metrics.downsampling_loss(positions(t), USER, "pos", "value", 4)
    return out.withColumn("lost_share", F.coalesce(F.round("lost_share", 8), F.lit(-1.0)))


@query(
    "conditional_sums",
    "A1",
    f"""WITH {ACTIVITY} SELECT (us // 86400000000)::BIGINT AS day, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS bought, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 2) AS failed, count(*) FILTER (event_type = 'click' AND value > 10) AS clicks FROM activity GROUP BY 1""",
)
def conditional_sums(t: Tables):
    def part(kind):
        return F.round(F.sum(F.when(is_type(kind), F.col("value")).otherwise(0.0)), 2)

    day = F.floor(F.col("us") / 86_400_000_000).alias("day")
    return t.activity.groupBy(day).agg(part("purchase").alias("bought"), part("error").alias("failed"), F.count_if(is_type("click") & (F.col("value") > 10)).alias("clicks"))


@query(
    "table_digest",
    "S16",
    """SELECT count(*) AS n, true AS stable FROM lineitem""",
)
def table_digest(t: Tables):
    a = quality.table_digest(t.lineitem).withColumnRenamed("digest", "d1")
    b = quality.table_digest(t.lineitem.orderBy("l_extendedprice")).withColumnRenamed("digest", "d2")
    return a.join(b, "n").select("n", (F.col("d1") == F.col("d2")).alias("stable"))


@query("sketch_edges", "A5 A17", """SELECT event_type, count(*) AS n, true AS within FROM events GROUP BY 1""")
def sketch_edges(t: Tables):
    """Displacement edges from stored daily sketches; ``within`` measures their ranks against all rows."""
    shares = [i / 6 for i in range(1, 6)]
    rows = t.events.select("event_type", F.to_date("ts").alias("day"), "value")
    folder = scratch(t.spark, "sketches")
    sketches.write_sketches(rows, folder, ["event_type"], "day", "value")
    stored = sketches.merged(t.spark.read.parquet(folder), ["event_type"])
    edges = stored.select("event_type", sketches.sketch_quantiles(F.col("sketch"), shares).alias("edges"))
    found = sketches.rank_errors(rows, edges, ["event_type"], "value", shares)
    return found.select("event_type", "n", (F.col("error") <= 2 * sketches.rank_error()).alias("within"))
