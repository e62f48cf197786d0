"""As-of, nearest, window and interval joins on the activity stream and the orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import align, ordered, samples
from tickloom.plans.registry import ACTIVITY, Tables, query

HOUR = 3_600_000_000
DAY = 24 * HOUR
CODES = ["purchase", "error", "none"]  # label vocabulary, ties go to the first


def kind(t: Tables, *types: str):
    return t.activity.filter(F.col("event_type").isin(*types))


@query(
    "asof_backward_capped",
    "J4 X1",
    f"""WITH {ACTIVITY}, e AS (SELECT user_id, us FROM activity WHERE event_type = 'error')
    SELECT a.event_id, a.user_id, CAST(coalesce(least(a.us - e.us, {6 * HOUR}), {6 * HOUR}) AS BIGINT) AS since
    FROM activity a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.us >= e.us""",
)
def asof_backward_capped(t: Tables):
    out = align.since_last(t.activity, kind(t, "error"), ["user_id"], "us", 6 * HOUR)
    return out.select("event_id", "user_id", "since")


@query(
    "asof_forward_label",
    "J3",
    f"""WITH {ACTIVITY}, e AS (SELECT user_id, us, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS code
        FROM activity WHERE event_type IN ('purchase', 'error'))
    SELECT a.event_id, CASE WHEN e.us - a.us <= {6 * HOUR} THEN e.code ELSE 2 END::BIGINT AS label,
           CASE WHEN e.us - a.us <= {6 * HOUR} THEN e.us - a.us ELSE {6 * HOUR} END::BIGINT AS time_to
    FROM activity a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.us <= e.us""",
)
def asof_forward_label(t: Tables):
    coded = kind(t, "purchase", "error").withColumn("code", F.when(F.col("event_type") == "purchase", 0).otherwise(1))
    out = align.label_next(t.activity, coded, ["user_id"], "us", "code", 6 * HOUR, CODES.index("none"))
    return out.select("event_id", "label", "time_to")


@query(
    "asof_nearest_tie",
    "J5",
    """WITH o AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) // 86400000000 AS d FROM orders),
    l AS (SELECT DISTINCT l_orderkey AS k, epoch_us(l_shipdate) // 86400000000 AS d FROM lineitem),
    r AS (SELECT o.k, o.d, l.d AS s, abs(l.d - o.d) AS gap FROM o JOIN l USING (k))
    SELECT k AS order_key, CAST(d AS BIGINT) AS day, CAST(arg_min(s, (gap, s)) AS BIGINT) AS earlier, CAST(arg_min(s, (gap, -s)) AS BIGINT) AS later
    FROM r GROUP BY k, d""",
)
def asof_nearest_tie(t: Tables):
    def day(c):
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(DAY)).cast("long")

    orders = t.orders.select(F.col("o_orderkey").cast("long").alias("order_key"), day("o_orderdate").alias("day"))
    ships = t.lineitem.select(F.col("l_orderkey").alias("order_key"), day("l_shipdate").alias("day"))
    ships = ordered.dealt(ships, ["order_key"], t.lineitem.count(), align.PART_ROWS).distinct()
    both = align.bracketing_events(orders, ships, ["order_key"], "day").filter("back IS NOT NULL OR ahead IS NOT NULL")
    picks = {tie: align.pick_nearest(F.col("day"), "back", "ahead", tie)["at"] for tie in ("earlier", "later")}
    return both.select("order_key", "day", *[c.alias(n) for n, c in picks.items()])


@query(
    "nearest_within",
    "J5",
    f"""WITH {ACTIVITY}, e AS (SELECT user_id, us, event_id AS hit FROM activity WHERE event_type = 'signup'),
    b AS (SELECT a.event_id, a.us, e.us AS bu, e.hit AS bh FROM activity a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.us >= e.us),
    f AS (SELECT a.event_id, e.us AS fu, e.hit AS fh FROM activity a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.us <= e.us)
    SELECT event_id, coalesce(CASE WHEN least(us - bu, fu - us) <= {8 * HOUR} THEN
        CASE WHEN fu IS NULL OR us - bu <= fu - us THEN bh ELSE fh END END, -1)::BIGINT AS hit,
        coalesce(least(us - bu, fu - us) <= {8 * HOUR}, false) AS found
    FROM b JOIN f USING (event_id)""",
)
def nearest_within(t: Tables):
    signups = kind(t, "signup").withColumn("hit", F.col("event_id"))
    out = align.nearest_event(t.activity, signups, ["user_id"], "us", ["hit"], max_distance=8 * HOUR)
    return out.select("event_id", F.coalesce("nearest.hit", F.lit(-1)).cast("long").alias("hit"), F.col("nearest").isNotNull().alias("found"))


@query(
    "horizon_nearest_state",
    "J6",
    f"""WITH {ACTIVITY}, m AS (SELECT user_id, max(us) AS last FROM activity GROUP BY 1),
    g AS (SELECT a.*, least(us + {12 * HOUR}, last) AS goal FROM activity a JOIN m USING (user_id)),
    b AS (SELECT g.event_id, g.goal, x.us AS bu, x.value AS bv FROM g ASOF LEFT JOIN activity x ON g.user_id = x.user_id AND g.goal >= x.us),
    f AS (SELECT g.event_id, x.us AS fu, x.value AS fv FROM g ASOF LEFT JOIN activity x ON g.user_id = x.user_id AND g.goal <= x.us)
    SELECT event_id, round(CASE WHEN fu IS NULL OR goal - bu < fu - goal THEN bv ELSE fv END, 6) AS future_value FROM b JOIN f USING (event_id)""",
)
def horizon_nearest_state(t: Tables):
    frames = ordered.per_key(t.activity, ["user_id"], [F.max("us").alias("last")])
    out = align.at_horizon(frames, ["user_id"], "us", 12 * HOUR, ["value"], end="last", tie="later")
    return out.select("event_id", F.round("future.value", 6).alias("future_value"))


@query(
    "range_first_in_window",
    "J7",
    f"""WITH {ACTIVITY}, j AS (
      SELECT a.event_id, a.us, min(b.us) FILTER (b.event_type = 'click') AS given, min(b.us) FILTER (b.event_type = 'view') AS taken
      FROM activity a JOIN activity b ON a.user_id = b.user_id AND b.us BETWEEN a.us AND a.us + {2 * HOUR} GROUP BY ALL)
    SELECT event_id, coalesce(given <= taken, given IS NOT NULL) AS initiated,
      round(coalesce(least(greatest((least(given, taken) - us) / {2 * HOUR}.0, 0), 1), 1), 6) AS delay FROM j""",
)
def range_first_in_window(t: Tables):
    flags = {"given": F.col("event_type") == "click", "taken": F.col("event_type") == "view"}
    out = align.window_first(t.activity, t.activity, ["user_id"], "us", flags, 2 * HOUR)
    initiated, delay = align.engagement(F.col("given"), F.col("taken"), F.col("us"), 2 * HOUR)
    return out.select("event_id", initiated.alias("initiated"), F.round(delay, 6).alias("delay"))


@query(
    "interval_labels",
    "J8",
    f"""WITH {ACTIVITY}, e AS (SELECT user_id, us FROM activity WHERE event_type = 'error'),
    c AS (SELECT a.event_id, count(e.us) FILTER (e.us > a.us AND e.us <= a.us + {HOUR}) AS pos,
        count(e.us) FILTER (e.us BETWEEN a.us - {HOUR // 2} AND a.us + {2 * HOUR}) AS near
      FROM activity a LEFT JOIN e ON a.user_id = e.user_id GROUP BY 1)
    SELECT event_id, CASE WHEN pos > 0 THEN 1 WHEN near = 0 THEN 0 ELSE -1 END::BIGINT AS label FROM c""",
)
def interval_labels(t: Tables):
    out = align.interval_labels(t.activity, kind(t, "error"), ["user_id"], "us", HOUR, HOUR // 2, 2 * HOUR)
    return out.select("event_id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


@query(
    "event_triggered_avg",
    "J9",
    f"""WITH {ACTIVITY}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos FROM activity),
    o AS (SELECT unnest(range(-8, 9)) AS off)
    SELECT off AS "offset", count(*) AS n, round(avg(f.value), 6) AS mean_value
    FROM p e CROSS JOIN o JOIN p f ON f.user_id = e.user_id AND f.pos = e.pos + off WHERE e.event_type = 'error' GROUP BY off""",
)
def event_triggered_avg(t: Tables):
    frames = ordered.ranked(t.activity, ["user_id"], "us", "pos", tie=["event_id"])
    out = align.event_triggered(frames, frames.filter("event_type = 'error'"), ["user_id"], "pos", "value", 8, 8)
    return out.select(F.col("offset").cast("long"), "n", F.round("mean_value", 6).alias("mean_value"))


STATUS = {"purchase": "settled", "error": "broken", "signup": "open", "click": "open"}  # view stays at the default


@query(
    "last_state_asof",
    "J24",
    f"""WITH {ACTIVITY}, e AS (SELECT user_id, us, max(event_type) AS s FROM activity WHERE event_type <> 'view' GROUP BY 1, 2),
    f AS (SELECT user_id, min(us) AS first_purchase FROM activity WHERE event_type = 'purchase' GROUP BY 1)
    SELECT a.event_id, CASE e.s WHEN 'purchase' THEN 'settled' WHEN 'error' THEN 'broken' WHEN 'signup' THEN 'open' WHEN 'click' THEN 'open' ELSE 'idle' END AS status,
      CASE WHEN f.first_purchase <= a.us THEN 'after' ELSE 'before' END AS phase
    FROM activity a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.us >= e.us LEFT JOIN f ON f.user_id = a.user_id""",
)
def last_state_asof(t: Tables):
    changes = t.activity.filter("event_type <> 'view'").withColumn("state", F.col("event_type"))
    out = samples.status_at(t.activity, changes, ["user_id"], "us", "state", STATUS, default="idle")
    out = ordered.per_key(out, ["user_id"], [F.min(F.when(F.col("event_type") == "purchase", F.col("us"))).alias("first")])
    phase = F.when(F.col("first") <= F.col("us"), "after").otherwise("before")
    return out.select("event_id", "status", phase.alias("phase"))


@query(
    "snapshot_fallback",
    "J25",
    f"""WITH {ACTIVITY}, v AS (SELECT user_id, us, event_id FROM activity WHERE event_type = 'view'),
    f AS (SELECT user_id, arg_min(event_id, us) AS first_id FROM v GROUP BY 1)
    SELECT a.event_id, coalesce(v.event_id, f.first_id, -1) AS snapshot
    FROM activity a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.us >= v.us LEFT JOIN f ON f.user_id = a.user_id""",
)
def snapshot_fallback(t: Tables):
    views = kind(t, "view").withColumn("snap", F.col("event_id"))
    out = samples.snapshot(t.activity, views, ["user_id"], "us", ["snap"])
    return out.select("event_id", F.coalesce("snapshot.snap", F.lit(-1)).cast("long").alias("snapshot"))


@query(
    "interval_sampling",
    "W13",
    f"""WITH {ACTIVITY}, s AS (SELECT user_id, min(us) AS a, max(us) AS b FROM activity GROUP BY 1),
    g AS (SELECT user_id, unnest(range(a, b + 1, {6 * HOUR})) AS goal FROM s),
    b AS (SELECT g.*, x.us AS bu, x.event_id AS bi FROM g ASOF LEFT JOIN activity x ON g.user_id = x.user_id AND g.goal >= x.us),
    f AS (SELECT b.*, x.us AS fu, x.event_id AS fi FROM b ASOF LEFT JOIN activity x ON b.user_id = x.user_id AND b.goal <= x.us)
    SELECT DISTINCT user_id, CASE WHEN fu IS NULL OR goal - bu < fu - goal THEN bi ELSE fi END AS event_id FROM f""",
)
def interval_sampling(t: Tables):
    out = samples.sample_every(t.activity, ["user_id"], "us", 6 * HOUR, ["event_id"])
    return out.select("user_id", "event_id")
