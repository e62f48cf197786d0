"""Window operators on the activity stream (episode = user, order = time)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import ordered, samples, windows
from tickloom.plans.registry import ACTIVITY, Tables, query

HOUR = 3_600_000_000
USER = ["user_id"]
ID = ["event_id"]
W = "OVER (PARTITION BY user_id ORDER BY us, event_id)"


def is_type(name: str):
    return F.col("event_type") == name


def positions(t: Tables):
    return ordered.ranked(t.activity, USER, "us", "pos", tie=ID)


@query(
    "downsample_nth_present",
    "W1",
    f"""WITH {ACTIVITY}, d AS (SELECT user_id, us, dense_rank() OVER (PARTITION BY user_id ORDER BY us) - 1 AS p FROM activity)
    SELECT a.event_id, p // 8 AS frame FROM activity a JOIN (SELECT DISTINCT * FROM d WHERE p % 8 = 0) d USING (user_id, us)""",
)
def downsample_nth_present(t: Tables):
    return windows.keep_every(t.activity, USER, "us", 8).select("event_id", "frame")


@query(
    "grid_downsample",
    "W1",
    """SELECT l_orderkey AS episode, l_linenumber::BIGINT AS line, (l_linenumber - m) // 2 AS frame FROM
    (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE (l_linenumber - m) % 2 = 0""",
)
def grid_downsample(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").cast("long").alias("line"))
    return windows.keep_on_grid(rows, ["episode"], "line", 2)


@query(
    "slot_assignment",
    "W2 J2",
    """WITH r AS (SELECT c_nationkey, lower(c_mktsegment) AS side, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer
      WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
    SELECT c_nationkey::BIGINT AS episode, c_custkey::BIGINT AS entity, side, CASE side WHEN 'building' THEN n - 1 ELSE n + 4 END AS slot FROM r WHERE n <= 5""",
)
def slot_assignment(t: Tables):
    # every customer of a nation is present at its first tick
    rows = t.customer.select(
        F.col("c_nationkey").cast("long").alias("episode"), F.lit(0).alias("tick"), F.col("c_custkey").cast("long").alias("entity"), F.col("c_mktsegment").alias("side")
    )
    return windows.assign_slots(rows, ["episode"], "tick", "entity", "side", ["building", "machinery"])


@query(
    "running_score",
    "W3",
    f"""WITH {ACTIVITY} SELECT event_id,
      (count(*) FILTER (event_type = 'purchase') OVER w)::BIGINT AS score_purchase, (count(*) FILTER (event_type = 'error') OVER w)::BIGINT AS score_error
    FROM activity WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def running_score(t: Tables):
    numbered = positions(t)
    out = windows.scores_before(numbered, USER, "pos", "event_type", ["purchase", "error"])
    return out.select("event_id", "score_purchase", "score_error")


@query(
    "displacement_velocity",
    "W4 J6",
    f"""WITH {ACTIVITY} SELECT event_id, round(lead(value, 8) {W} - value, 6) AS d_value, round(value - lag(value) {W}, 6) AS v_value,
      round((value - lag(value, 4) {W}) / 4, 6) AS vs_value FROM activity""",
)
def displacement_velocity(t: Tables):
    out = windows.displacement(t.activity, USER, "us", ["value"], 8, tie=ID)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("d_value", "v_value", "vs_value")])


@query(
    "hold_until_reset",
    "W6 X2",
    f"""WITH {ACTIVITY}, g AS (SELECT *, count(*) FILTER (event_type IN ('error', 'purchase', 'signup')) {W} AS grp FROM activity),
    h AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id, grp ORDER BY us, event_id) AS opener, first_value(value) OVER (PARTITION BY user_id, grp ORDER BY us, event_id) AS v FROM g)
    SELECT event_id, CASE WHEN opener = 'error' THEN v ELSE -1 END AS held FROM h""",
)
def hold_until_reset(t: Tables):
    reset = F.col("event_type").isin("purchase", "signup")
    out = windows.hold_until(t.activity, USER, "us", is_type("error"), F.col("value"), reset, "held", tie=ID)
    return out.select("event_id", F.coalesce("held", F.lit(-1.0)).alias("held"))


@query(
    "hold_after_falling_edge",
    "W6",
    f"""WITH {ACTIVITY}, a AS (SELECT *, event_type = 'view' AS carried, event_type = 'purchase' AS planted FROM activity),
    b AS (SELECT *, coalesce(lag(carried) {W}, false) AND NOT carried AND NOT planted AS edge, lag(value) {W} AS pv FROM a),
    g AS (SELECT *, count(*) FILTER (edge OR carried OR planted) {W} AS grp FROM b),
    h AS (SELECT *, first_value(edge) OVER (PARTITION BY user_id, grp ORDER BY us, event_id) AS o, first_value(pv) OVER (PARTITION BY user_id, grp ORDER BY us, event_id) AS v FROM g)
    SELECT event_id, coalesce(CASE WHEN o AND grp > 0 THEN v END, -1) AS drop_x, edge AS is_drop FROM h""",
)
def hold_after_falling_edge(t: Tables):
    frames = positions(t).select(
        "user_id", "event_id", "pos", is_type("view").alias("carried"), is_type("purchase").alias("planted"), F.when(is_type("view"), F.col("value")).alias("x")
    )
    out = windows.hold_dropped(frames, USER, "pos", "carried", "planted", "x", "x")
    return out.select("event_id", F.coalesce("drop_x", F.lit(-1.0)).alias("drop_x"), "is_drop")


@query(
    "time_since_true_reset",
    "W7",
    f"""WITH {ACTIVITY}, p AS (SELECT *, row_number() {W} AS pos FROM activity),
    m AS (SELECT *, max(pos) FILTER (event_type = 'click') {W} AS f, max(pos) FILTER (event_type = 'error') {W} AS r FROM p)
    SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN f IS NOT NULL AND (r IS NULL OR f > r) THEN least(pos - f, 64) ELSE 64 END::BIGINT AS since FROM m""",
)
def time_since_true_reset(t: Tables):
    out = windows.time_since(positions(t), USER, "pos", is_type("click"), is_type("error"), 64, "since")
    return out.select("event_id", "since")


@query(
    "first_true_frame",
    "W8 P9 P11",
    f"""WITH {ACTIVITY}, p AS (SELECT *, row_number() {W} AS pos FROM activity), q AS (SELECT *, min(pos) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS f FROM p)
    SELECT event_id, coalesce(f, -1)::BIGINT AS first_pos, greatest(0, pos - coalesce(f, 1)) / 8.0::DOUBLE AS clock_s FROM q""",
)
def first_true_frame(t: Tables):
    out = ordered.per_key(positions(t), USER, [F.min(F.when(is_type("purchase"), F.col("pos"))).alias("f")])
    clock = F.greatest(F.lit(0), F.col("pos") - F.coalesce("f", F.lit(1))) / 8.0
    return out.select("event_id", F.coalesce("f", F.lit(-1)).cast("long").alias("first_pos"), clock.alias("clock_s"))


@query(
    "trailing_mean",
    "W9",
    f"""WITH {ACTIVITY} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS 15 PRECEDING), 8) AS mean16,
      round(avg(value) {W}, 8) AS mean_all FROM activity""",
)
def trailing_mean(t: Tables):
    out = windows.trailing_mean(t.activity, USER, "us", "value", 16, "mean16", tie=ID)
    out = windows.mean_so_far(out, USER, "us", "value", "mean_all", tie=ID)
    return out.select("event_id", F.round("mean16", 8).alias("mean16"), F.round("mean_all", 8).alias("mean_all"))


@query(
    "causal_mean_range",
    "W9",
    f"""WITH {ACTIVITY} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW), 5) AS mean12h FROM activity""",
)
def causal_mean_range(t: Tables):
    out = windows.causal_mean(t.activity, USER, "us", "value", 12 * HOUR, "mean12h")
    return out.select("event_id", F.round("mean12h", 5).alias("mean12h"))


GAP = f"""g AS (SELECT *, coalesce(us - lag(us) {W} > {12 * HOUR}, false) AS b FROM activity),
    s AS (SELECT *, (count(*) FILTER (b) {W})::BIGINT AS segment FROM g),
    t AS (SELECT user_id, segment, count(*) AS n, avg(value) AS m, var_pop(value) AS v, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases FROM s GROUP BY 1, 2)"""


def sessions(t: Tables, cap: int | None = None):
    def gap(w):
        return {"__gap": F.coalesce(F.col("us") - F.lag("us").over(w) > 12 * HOUR, F.lit(False))}

    rows = ordered.framed(t.activity, USER, "us", gap, before=1, after=0, tie=ID)
    return windows.segments(rows, USER, "us", F.col("__gap"), cap=cap, tie=ID)


def session_stats(t: Tables):
    flags = {"errors": is_type("error"), "purchases": is_type("purchase")}
    return windows.segment_stats(sessions(t), USER, "value", flags)


@query(
    "segment_ids_stats",
    "W17",
    f"""WITH {ACTIVITY}, {GAP} SELECT user_id, segment, n, round(m, 8) AS mean_value, round(v, 2) AS within_var, errors, purchases FROM t""",
)
def segment_ids_stats(t: Tables):
    return session_stats(t).select(
        "user_id", "segment", "n", F.round("mean_value", 8).alias("mean_value"), F.round("within_var", 2).alias("within_var"), "errors", "purchases"
    )


@query(
    "segment_ids_clamped",
    "W17",
    f"""WITH {ACTIVITY}, {GAP}, c AS (SELECT *, least(segment, 31)::BIGINT AS clamped FROM s) SELECT user_id, clamped AS segment, count(*) AS n, min(us) AS first_us FROM c GROUP BY 1, 2""",
)
def segment_ids_clamped(t: Tables):
    out = sessions(t, cap=32).groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"))
    return out.select("user_id", F.col("segment").cast("long").alias("segment"), "n", "first_us")


@query(
    "segment_next_target",
    "W17",
    f"""WITH {ACTIVITY}, {GAP} SELECT a.user_id, a.segment, b.errors AS next_errors, b.purchases AS next_purchases FROM t a JOIN t b ON a.user_id = b.user_id AND b.segment = a.segment + 1""",
)
def segment_next_target(t: Tables):
    out = windows.next_segment_target(session_stats(t), USER, ["errors", "purchases"])
    return out.select("user_id", "segment", "next_errors", "next_purchases")


@query(
    "forward_window_counts",
    "W18",
    f"""WITH {ACTIVITY} SELECT event_id, (count(*) FILTER (event_type = 'click') OVER w)::BIGINT AS clicks, (count(*) FILTER (event_type = 'view') OVER w)::BIGINT AS views,
      count(*) FILTER (event_type = 'purchase') OVER w > 0 AS any_purchase, count(*) OVER w = 8 AS valid
    FROM activity WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)""",
)
def forward_window_counts(t: Tables):
    out = windows.ahead_counts(
        t.activity, USER, "us", 8, {"clicks": is_type("click"), "views": is_type("view")}, {"any_purchase": is_type("purchase")}, tie=ID
    )
    return out.select("event_id", "clicks", "views", "any_purchase", "valid")


@query(
    "transition_events",
    "W14",
    f"""WITH {ACTIVITY}, h AS (SELECT *, CASE WHEN value < 20 THEN 0 ELSE floor(value)::BIGINT END AS hp FROM activity),
    p AS (SELECT *, lag(hp) {W} AS prev FROM h) SELECT event_id, user_id, us FROM p WHERE prev > 0 AND hp = 0""",
)
def transition_events(t: Tables):
    rows = t.activity.withColumn("hp", F.when(F.col("value") < 20, 0).otherwise(F.floor("value")))
    return samples.falling_to_zero(rows, USER, "us", "hp", tie=ID).select("event_id", "user_id", "us")


@query(
    "lost_items",
    "W14 P27",
    """WITH i AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey, l_extendedprice, l_quantity > 5 AS alive, list_filter(['smoke', 'flash', 'molly', 'he', 'decoy'],
        lambda x: CASE x WHEN 'smoke' THEN l_suppkey % 2 = 0 WHEN 'flash' THEN l_partkey % 3 = 0 WHEN 'molly' THEN l_quantity > 25 WHEN 'he' THEN l_discount > 0.05 ELSE l_tax > 0.04 END) AS inv FROM lineitem),
    p AS (SELECT *, lag(inv) OVER w AS held, lag(alive) OVER w AS was FROM i WINDOW w AS (PARTITION BY k ORDER BY n, l_partkey, l_extendedprice)),
    u AS (SELECT k, n, inv, unnest(held) AS item FROM p WHERE was)
    SELECT k AS order_key, n::BIGINT AS line, item FROM u WHERE NOT list_contains(inv, item) AND item IN ('smoke', 'flash', 'molly', 'he')""",
)
def lost_items(t: Tables):
    held = F.array_compact(
        F.array(
            F.when(F.col("l_suppkey") % 2 == 0, "smoke"),
            F.when(F.col("l_partkey") % 3 == 0, "flash"),
            F.when(F.col("l_quantity") > 25, "molly"),
            F.when(F.col("l_discount") > 0.05, "he"),
            F.when(F.col("l_tax") > 0.04, "decoy"),
        )
    )
    rows = t.lineitem.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_extendedprice", "l_quantity", held.alias("inv"))
    watched = F.array(*[F.lit(x) for x in ("smoke", "flash", "molly", "he")])
    return samples.lost_items(rows, ["order_key"], "line", "inv", F.col("l_quantity") > 5, watched, tie=["l_partkey", "l_extendedprice"]).select("order_key", "line", "item")


@query(
    "prior_two",
    "W15",
    """SELECT o_orderkey::BIGINT AS order_key, coalesce(array_to_string(array_agg(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS prior FROM orders""",
)
def prior_two(t: Tables):
    rows = t.orders.select(
        F.col("o_orderkey").cast("long").alias("order_key"), "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us")
    )
    out = samples.previous_values(rows, ["o_custkey"], "us", "order_key", 2, "prior", tie=["order_key"])
    return out.select("order_key", F.concat_ws(",", F.transform("prior", lambda x: x.cast("string"))).alias("prior"))


@query(
    "monotonic_violations",
    "W16",
    """WITH p AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
    SELECT o_custkey::BIGINT AS customer, count(*) AS n, count(*) FILTER (o_totalprice - prev < -0.001) AS decreases FROM p GROUP BY 1""",
)
def monotonic_violations(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    out = windows.backward_steps(rows, ["o_custkey"], "us", "o_totalprice", 0.001, tie=["o_orderkey"])
    return out.groupBy(F.col("o_custkey").cast("long").alias("customer")).agg(F.count(F.lit(1)).alias("n"), F.count_if("decreases").alias("decreases"))


@query(
    "topk_per_group",
    "W19",
    """WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT l_orderkey AS order_key, l_linenumber::BIGINT AS line, r AS pick_rank FROM p WHERE r <= greatest(1, round_even(0.5::DOUBLE * n, 0))""",
)
def topk_per_group(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice")
    out = windows.top_fraction(rows, ["order_key"], "l_extendedprice", 0.5, "line")
    return out.select("order_key", "line", F.col("pick_rank").cast("long").alias("pick_rank"))


@query(
    "step_score",
    "W20",
    f"""WITH {ACTIVITY}, s AS (SELECT *, abs(value - lag(value) {W}) AS step FROM activity)
    SELECT event_id, coalesce(round(step / greatest(avg(step) OVER (PARTITION BY user_id), 1e-6), 5), -1) AS score FROM s""",
)
def step_score(t: Tables):
    out = windows.step_score(t.activity, USER, "us", ["value"], tie=ID)
    return out.select("event_id", F.coalesce(F.round("score", 5), F.lit(-1.0)).alias("score"))


@query(
    "even_positions",
    "W10",
    f"""WITH c AS (SELECT user_id, count(*) AS t, least(20, count(*) // 10) AS skip FROM events GROUP BY 1)
    SELECT user_id, unnest(CASE WHEN t - skip <= 8 THEN range(skip, t) ELSE list_transform(range(8), lambda i: floor(skip + i * ((t - 1 - skip) / 7.0::DOUBLE))::BIGINT) END) AS position FROM c""",
)
def even_positions(t: Tables):
    lengths = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("t"))
    return windows.even_positions(lengths, "t", 8).select("user_id", "position")


@query(
    "fraction_positions",
    "W11",
    """WITH c AS (SELECT user_id, count(*) AS t FROM events GROUP BY 1)
    SELECT user_id, f::DOUBLE AS fraction, floor(f * t)::BIGINT AS "end" FROM c, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS f) WHERE floor(f * t) >= 16""",
)
def fraction_positions(t: Tables):
    lengths = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("t"))
    return windows.fraction_ends(lengths, "t", [0.25, 0.5, 0.75], 16).select("user_id", "fraction", "end")


@query(
    "strided_anchors",
    "W12",
    f"""WITH {ACTIVITY}, p AS (SELECT *, row_number() {W} AS pos FROM activity),
    h AS (SELECT *, ('0x' || substr(sha256(user_id || '#' || pos || '#7'), 1, 13))::BIGINT AS h FROM p WHERE pos >= 16 AND (pos - 16) % 4 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, pos) AS n FROM h)
    SELECT user_id, pos::BIGINT AS pos FROM r WHERE n <= 3 ORDER BY h, user_id, pos LIMIT 300""",
)
def strided_anchors(t: Tables):
    return windows.strided_anchors(positions(t), USER, "pos", 16, 4, 3, 300, seed=7).select("user_id", "pos")


@query(
    "training_crops",
    "W5 F4",
    f"""WITH {ACTIVITY}, p AS (SELECT *, row_number() {W} - 1 AS pos FROM activity),
    c AS (SELECT user_id, pos, list(event_id) OVER (w ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS x, list(event_id) OVER (w ROWS BETWEEN 8 FOLLOWING AND 23 FOLLOWING) AS y,
      list(event_id) OVER (w ROWS BETWEEN 1 PRECEDING AND 14 FOLLOWING) AS xp FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    h AS (SELECT *, ('0x' || substr(sha256(user_id || '#' || pos || '#0'), 1, 13))::BIGINT AS h FROM c WHERE pos >= 1 AND len(y) = 16 AND len(xp) = 16),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, pos) AS n FROM h)
    SELECT user_id, pos::BIGINT AS start, array_to_string(x, ',') AS x, array_to_string(y, ',') AS y, array_to_string(xp, ',') AS x_prev FROM r WHERE n <= 4""",
)
def training_crops(t: Tables):
    frames = positions(t).withColumn("pos", F.col("pos") - 1)
    out = windows.crops(frames, USER, "pos", "event_id", 16, 8, 4)

    def text(c):
        return F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)

    return out.select("user_id", F.col("pos").cast("long").alias("start"), text("x"), text("y"), text("x_prev"))


@query(
    "supervision_mask",
    "F5",
    f"""WITH {ACTIVITY} SELECT event_id, value > 20 AND coalesce(lead(value > 20, 8) {W}, false) AND event_type <> 'signup' AS supervised FROM activity""",
)
def supervision_mask(t: Tables):
    rows = positions(t).withColumns({"alive": F.col("value") > 20, "frozen": is_type("signup")})
    return windows.supervised(rows, USER, "pos", "alive", "frozen", 8).select("event_id", "supervised")


@query(
    "tail_crop",
    "F6 F7",
    f"""WITH {ACTIVITY}, p AS (SELECT *, row_number() {W} AS pos FROM activity), q AS (SELECT *, min(pos) FILTER (event_type = 'signup') OVER (PARTITION BY user_id) AS f, count(*) OVER (PARTITION BY user_id) AS old_n FROM p),
    k AS (SELECT * FROM q WHERE f IS NULL OR pos < f + 7)
    SELECT user_id, count(*) AS n_ticks, max(us) AS last_tick, any_value(old_n) AS original_n, CASE WHEN count(*) < any_value(old_n) THEN 'exact' ELSE 'unchanged' END AS source FROM k GROUP BY 1""",
)
def tail_crop(t: Tables):
    frames = positions(t)
    kept = windows.crop_tail(frames, USER, "pos", is_type("signup"), 7)
    old = frames.groupBy("user_id").agg(F.count(F.lit(1)).alias("original_n"))
    new = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_ticks"), F.max("us").alias("last_tick"))
    source = F.when(F.col("n_ticks") < F.col("original_n"), "exact").otherwise("unchanged")
    return new.join(old, "user_id").select("user_id", "n_ticks", "last_tick", "original_n", source.alias("source"))


FIRE = f"""WITH RECURSIVE {ACTIVITY}, o AS (SELECT user_id, event_id, coalesce(value, 0) AS x, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM activity),
    r AS (SELECT user_id, event_id, k, x AS level FROM o WHERE k = 1
        UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN r.level >= 400 THEN 0 ELSE r.level END + o.x FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)"""


@query("integrate_and_fire", "W21 X5", f"{FIRE} SELECT user_id, event_id, k AS pos, o.x AS value FROM r JOIN o USING (user_id, event_id, k) WHERE level >= 400")
def integrate_and_fire(t: Tables):
    frames = positions(t).select("user_id", "event_id", F.col("pos").cast("long").alias("pos"), "value")
    return windows.integrate_and_fire(frames, USER, "pos", "value", 400.0)
