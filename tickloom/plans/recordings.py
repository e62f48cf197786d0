"""The recording pipeline end to end, on tick and event tables read out of the order lines.

16 neighbouring orders form a round, 20 rounds a recording; suppliers are the players.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import vocab as V
from tickloom.operators import align, frames, ordered, samples, windows
from tickloom.operators.ordered import join_on
from tickloom.plans.registry import ACTIVITY, Tables, query
from tickloom.session import scratch

HOUR = 3_600_000_000


def keyed(order: str):
    ep = F.floor(F.col(order) / 16)
    number = F.coalesce(F.floor(ep / 20).cast("string"), F.lit("null"))  # a formatter per row would cost more than the rest of a scan
    return F.concat(F.lit("rec"), number).alias("demo_stem"), (ep % 20).cast("int").alias("round_num")


def lines(t: Tables) -> DataFrame:
    return t.lineitem.select(*keyed("l_orderkey"), "*")


def ticks(t: Tables, parts: int | None = None) -> DataFrame:
    """The last row of each player and tick; with ``parts``, of lines dealt by round."""
    c = F.col
    player = (c("l_suppkey") % 10).cast("long")
    state = F.struct(
        c("l_extendedprice").alias("price"), c("l_partkey").alias("part"), c("l_quantity").alias("qty"), c("l_tax").alias("tax"), c("l_returnflag").alias("flag")
    )
    g = ordered.near(lines(t), frames.EPISODE, parts).groupBy("demo_stem", "round_num", (c("l_linenumber") * 40 + c("l_partkey") % 5 * 8).cast("int").alias("tick"), player.alias("steamid")).agg(F.max(state).alias("s"))
    inv = F.array_compact(
        F.array(
            F.when(c("s.part") % 4 == 0, "AWP").when(c("s.part") % 4 == 1, "AK-47"), F.lit("Glock-18"),
            F.when(c("s.part") % 3 == 0, "Smoke Grenade"), F.when((c("s.part") % 6 == 0) & (c("steamid") < 5), "C4 Explosive"),
        )
    )
    return g.select(
        "demo_stem", "round_num", "tick", "steamid", F.when(c("steamid") < 5, "t").otherwise("ct").alias("side"),
        (c("s.price") / 20 - 2500).alias("X"), (c("s.part") * 2.0 - 2000).alias("Y"), F.lit(0.0).alias("Z"), (c("s.qty") * 7.2).alias("yaw"), F.lit(0.0).alias("pitch"),
        F.when(c("s.flag") == "R", 0).otherwise(c("s.qty") * 2).cast("int").alias("health"), (c("s.tax") * 1000).cast("int").alias("armor"), F.floor(c("s.price") / 10).cast("int").alias("balance"),
        F.floor(c("s.price") / 20).cast("int").alias("current_equip_value"), F.lit(True).alias("has_helmet"), F.lit(None).cast("boolean").alias("has_defuser"), inv.alias("inventory"),
    )


def kills(t: Tables) -> DataFrame:
    c = F.col
    side = F.when(c("l_partkey") % 5 == 0, None).when(c("l_linestatus") == "O", "T").otherwise("ct")
    return lines(t).filter("l_returnflag = 'R' AND l_quantity > 30").select("demo_stem", "round_num", (c("l_linenumber") * 40 + c("l_partkey") % 40).cast("int").alias("tick"), side.alias("attacker_side"))


def bomb(t: Tables) -> DataFrame:
    c = F.col
    event = F.element_at(F.array(*[F.lit(e) for e in ("plant", "drop", "pickup", "defuse")]), (c("l_suppkey") % 4 + 1).cast("int"))
    rows = lines(t).filter("l_returnflag = 'A' AND l_quantity > 35 AND l_linenumber > 3")
    return rows.select(
        "demo_stem", "round_num", (c("l_linenumber") * 40 + c("l_partkey") % 40).cast("int").alias("tick"), event.alias("event"),
        (c("l_extendedprice") / 20 - 2500).alias("X"), (c("l_partkey") * 2.0 - 2000).alias("Y"), F.lit(None).cast("double").alias("Z"), F.lit("BombsiteB").alias("bombsite"),
    )


def rounds(t: Tables) -> DataFrame:
    g = t.orders.select(*keyed("o_orderkey"), "o_custkey").groupBy("demo_stem", "round_num").agg(F.sum("o_custkey").alias("s"))
    plant = bomb(t).filter("event = 'plant'").groupBy("demo_stem", "round_num").agg(F.min("tick").alias("bomb_plant"))
    s = F.col("s")
    return join_on(g, plant, frames.EPISODE, "left").select(
        "demo_stem", "round_num", (60 + s % 30).cast("int").alias("freeze_end"), (250 + s % 60).cast("int").alias("end"), F.lit(None).cast("int").alias("official_end"), "bomb_plant",
        F.when(s % 2 == 0, "t").otherwise("CT").alias("winner"), F.when(s % 3 == 0, "bomb_exploded").otherwise("killed").alias("reason"),
    )


def header(t: Tables) -> DataFrame:
    stems = t.orders.select(keyed("o_orderkey")[0]).distinct()
    n = F.regexp_extract("demo_stem", r"(\d+)", 1).cast("int")
    return stems.withColumn("map_name", F.element_at(F.array(*[F.lit(m) for m in V.MAPS]), (n % len(V.MAPS) + 1).cast("int")))


SITES = ", ".join(f"('{m}', {c[0]}, {c[1]}, {c[2]}, {c[3]})" for m, c in V.SITE_CENTROIDS.items())
MAPS = "[" + ", ".join(f"'{m}'" for m in V.MAPS) + "]"
EP = "'rec' || (({0} // 16) // 20) AS demo_stem, ({0} // 16) % 20 AS round_num"
TABLES = f"""li AS (SELECT {EP.format('l_orderkey')}, * FROM lineitem),
    raw AS (SELECT demo_stem, round_num, l_linenumber * 40 + l_partkey % 5 * 8 AS tick, l_suppkey % 10 AS steamid, max({{'price': l_extendedprice, 'part': l_partkey, 'qty': l_quantity, 'tax': l_tax, 'flag': l_returnflag}}) AS s FROM li GROUP BY ALL),
    tk AS (SELECT demo_stem, round_num, tick, steamid, CASE WHEN steamid < 5 THEN 't' ELSE 'ct' END AS side, s.price / 20 - 2500 AS x, s.part AS part, s.qty AS qty, CASE WHEN s.flag = 'R' THEN 0 ELSE s.qty * 2 END AS health, floor(s.price / 10) AS balance, floor(s.price / 20) AS equip, s.part % 6 = 0 AND steamid < 5 AS c4 FROM raw),
    kl AS (SELECT demo_stem, round_num, l_linenumber * 40 + l_partkey % 40 AS tick, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS code FROM li WHERE l_returnflag = 'R' AND l_quantity > 30),
    bm AS (SELECT demo_stem, round_num, l_linenumber * 40 + l_partkey % 40 AS tick, ['plant', 'drop', 'pickup', 'defuse'][l_suppkey % 4 + 1] AS event, l_extendedprice / 20 - 2500 AS px, l_partkey * 2.0::DOUBLE - 2000 AS py FROM li WHERE l_returnflag = 'A' AND l_quantity > 35 AND l_linenumber > 3),
    fp AS (SELECT demo_stem, round_num, min({{'tick': tick, 'x': px, 'y': py}}) AS p FROM bm WHERE event = 'plant' GROUP BY 1, 2),
    rd AS (SELECT demo_stem, round_num, 60 + s % 30 AS freeze_end, 250 + s % 60 AS fin, CASE WHEN s % 2 = 0 THEN 't' ELSE 'ct' END AS winner, s % 3 = 0 AS boom, p, p.tick AS plant FROM (SELECT {EP.format('o_orderkey')}, sum(o_custkey) AS s FROM orders GROUP BY ALL) LEFT JOIN fp USING (demo_stem, round_num)),
    gr AS (SELECT demo_stem, round_num, tick, (n - 1) // 2 AS frame FROM (SELECT *, row_number() OVER (PARTITION BY demo_stem, round_num ORDER BY tick) AS n FROM (SELECT DISTINCT demo_stem, round_num, tick FROM tk)) WHERE (n - 1) % 2 = 0),
    sl AS (SELECT demo_stem, round_num, steamid, CASE side WHEN 't' THEN n - 1 ELSE n + 4 END AS slot FROM (SELECT *, row_number() OVER (PARTITION BY demo_stem, round_num, side ORDER BY steamid) AS n FROM (SELECT DISTINCT demo_stem, round_num, steamid, side FROM tk JOIN (SELECT demo_stem, round_num, min(tick) AS tick FROM tk GROUP BY 1, 2) USING (demo_stem, round_num, tick))) WHERE n <= 5)"""


@query(
    "round_frames_players",
    "J1 J2 W1 W2 P1 P3 S1",
    f"""WITH {TABLES} SELECT g.demo_stem, g.round_num::BIGINT AS round_num, g.frame, c.slot, t.steamid IS NOT NULL AS is_present, round(coalesce(t.x / 3000, 0), 8) AS x, round(coalesce(cos(radians(t.qty * 7.2)), 0), 8) AS cos_yaw, round(coalesce(t.health / 100, 0), 8) AS hp,
      CASE WHEN t.part % 4 = 0 THEN 'awp' WHEN t.part % 4 = 1 THEN 'rifle_t' ELSE 'other' END AS "primary", coalesce(t.c4, false)::INT::DOUBLE AS has_c4
    FROM gr g CROSS JOIN (SELECT unnest(range(10)) AS slot) c LEFT JOIN sl ON sl.demo_stem = g.demo_stem AND sl.round_num = g.round_num AND sl.slot = c.slot LEFT JOIN tk t ON t.demo_stem = g.demo_stem AND t.round_num = g.round_num AND t.tick = g.tick AND t.steamid = sl.steamid""",
)
def round_frames_players(t: Tables):
    tk = kept_ticks(t)[0]
    with ordered.bounded_groups([(tk, frames.EPISODE)]):
        out = frames.player_frames(tk, frames.frame_grid(tk, 2))
    return out.select("demo_stem", F.col("round_num").cast("long").alias("round_num"), "frame", "slot", "is_present", *[F.round(c, 8).alias(c) for c in ("x", "cos_yaw", "hp")], "primary", "has_c4")


@query(
    "round_frames_global",
    "P5 P6 P8 A1 J3 J4 W3 A37",
    f"""WITH {TABLES}, sc AS (SELECT demo_stem, round_num, (count(*) FILTER (winner = 't') OVER w)::BIGINT AS score_t, (count(*) FILTER (winner = 'ct') OVER w)::BIGINT AS score_ct FROM rd SEMI JOIN gr USING (demo_stem, round_num) WINDOW w AS (PARTITION BY demo_stem ORDER BY round_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    tt AS (SELECT demo_stem, round_num, tick, sum(CASE side WHEN 't' THEN balance ELSE -balance END) / 5e4 AS money_diff, count(*) FILTER (side = 't' AND health > 0) / 5 AS alive_t FROM tk GROUP BY 1, 2, 3),
    cc AS (SELECT demo_stem, round_num, tick, max(c4) AS c4 FROM tk JOIN sl USING (demo_stem, round_num, steamid) GROUP BY 1, 2, 3),
    le AS (SELECT demo_stem, round_num, tick, code FROM kl WHERE code IS NOT NULL UNION SELECT demo_stem, round_num, tick, CASE event WHEN 'plant' THEN 2 ELSE 3 END FROM bm WHERE event IN ('plant', 'defuse') UNION SELECT demo_stem, round_num, fin, 4 FROM rd WHERE boom UNION SELECT demo_stem, round_num, fin, 5 FROM rd),
    l1 AS (SELECT demo_stem, round_num, tick, min(code) AS code FROM le GROUP BY 1, 2, 3),
    te AS (SELECT demo_stem, round_num, tick FROM kl UNION SELECT demo_stem, round_num, tick FROM bm WHERE event IN ('plant', 'defuse') UNION SELECT demo_stem, round_num, fin FROM rd WHERE boom),
    kt AS (SELECT DISTINCT demo_stem, round_num, tick FROM kl),
    hd AS (SELECT DISTINCT demo_stem, {MAPS}[regexp_extract(demo_stem, '\\d+')::INT % 7 + 1] AS map_name FROM rd), ct(map_name, ax, ay, bx, by_) AS (VALUES {SITES}),
    f AS (SELECT g.*, rd.* EXCLUDE (demo_stem, round_num), hd.map_name, score_t, score_ct, money_diff, alive_t, coalesce(c4, false) AS c4, CASE WHEN (p.x - ax) ** 2 + (p.y - ay) ** 2 <= (p.x - bx) ** 2 + (p.y - by_) ** 2 THEN 'a' ELSE 'b' END AS site
      FROM gr g JOIN rd USING (demo_stem, round_num) JOIN sc USING (demo_stem, round_num) JOIN hd USING (demo_stem) LEFT JOIN ct USING (map_name) LEFT JOIN tt USING (demo_stem, round_num, tick) LEFT JOIN cc USING (demo_stem, round_num, tick)),
    a1 AS (SELECT f.*, kt.tick AS k FROM f ASOF LEFT JOIN kt ON f.demo_stem = kt.demo_stem AND f.round_num = kt.round_num AND f.tick >= kt.tick),
    a2 AS (SELECT a1.*, te.tick AS e FROM a1 ASOF LEFT JOIN te ON a1.demo_stem = te.demo_stem AND a1.round_num = te.round_num AND a1.tick >= te.tick),
    a3 AS (SELECT a2.*, l1.tick AS nt, l1.code AS nc FROM a2 ASOF LEFT JOIN l1 ON a2.demo_stem = l1.demo_stem AND a2.round_num = l1.round_num AND a2.tick <= l1.tick)
    SELECT demo_stem, round_num::BIGINT AS round_num, frame, map_name, score_t, score_ct, CASE WHEN tick >= fin THEN 'end' WHEN plant IS NOT NULL AND tick >= plant THEN 'post_plant' WHEN tick < freeze_end THEN 'freeze' ELSE 'live' END AS phase,
      CASE WHEN plant IS NOT NULL AND tick >= plant THEN 'planted_' || site WHEN c4 THEN 'carried' ELSE 'none' END AS bomb_state, round(greatest(0, (tick - freeze_end) / 64) / 115, 8) AS round_time, round(coalesce(money_diff, 0), 8) AS money_diff, round(coalesce(alive_t, 0), 8) AS alive_t,
      CASE WHEN plant IS NOT NULL AND tick >= plant THEN round((tick - plant) / 64 / 40, 10) ELSE 0 END AS bomb_age, coalesce(least(tick - k, 256), 256)::BIGINT AS since_kill, coalesce(least(tick - e, 256), 256)::BIGINT AS since_event,
      CASE WHEN nt - tick <= 256 THEN nc ELSE 6 END::BIGINT AS event_label, CASE WHEN nt - tick <= 256 THEN nt - tick ELSE 256 END::BIGINT AS event_time FROM a3""",
)
def round_frames_global(t: Tables):
    out = built(t)[0][1]
    keep = ["frame", "map_name", "score_t", "score_ct", "phase", "bomb_state", "since_kill", "since_event", "event_label", "event_time"]
    return out.select("demo_stem", F.col("round_num").cast("long").alias("round_num"), *keep, *[F.round(c, 8).alias(c) for c in ("round_time", "money_diff", "alive_t")], F.round("bomb_age", 10).alias("bomb_age"))


def kept_ticks(t: Tables) -> tuple[DataFrame, int | None]:
    """Ticks, an aggregate here, written once, as they come in a recording; and in how many buckets by round they lie.

    Lines are dealt by round and nothing else. Where a round is too large for a task, there are no buckets.
    """
    folder = scratch(t.spark, "ticks")
    with ordered.bounded_groups([(lines(t), frames.EPISODE)]) as n:
        if not ordered.covered(frames.EPISODE):
            ticks(t).write.parquet(folder)
            return t.spark.read.parquet(folder), None
        name, parts, stored = f"ticks_{uuid.uuid4().hex[:12]}", ordered.parts_for(t.spark, n), [f"in_{c}" for c in frames.EPISODE]
        rows = ticks(t, parts).withColumnsRenamed(dict(zip(frames.EPISODE, stored)))
        rows.write.option("path", folder).bucketBy(parts, *stored).saveAsTable(name)
    # columns named after a table's would carry its name, and a union would not know its parts to lie alike
    return t.spark.table(name).withColumnsRenamed(dict(zip(stored, frames.EPISODE))), parts


def built(t: Tables):
    """``frames.build`` of the order lines, and the ticks."""
    kept, parts = kept_ticks(t)
    return frames.build(kept, kills(t), bomb(t), rounds(t), header(t), 2, parts), kept


@query(
    "episode_meta",
    "A38 S10",
    f"""WITH {TABLES} SELECT demo_stem, round_num::BIGINT AS round_num, count(*) AS n_ticks, min(tick)::BIGINT AS first_tick, max(tick)::BIGINT AS last_tick, any_value(winner) AS winner FROM gr LEFT JOIN rd USING (demo_stem, round_num) GROUP BY 1, 2""",
)
def episode_meta(t: Tables):
    grid = frames.frame_grid(ticks(t), 2)
    out = frames.episodes(grid, rounds(t), header(t), 2)
    return out.select("demo_stem", F.col("round_num").cast("long").alias("round_num"), "n_ticks", *[F.col(c).cast("long").alias(c) for c in ("first_tick", "last_tick")], F.lower("winner").alias("winner"))


@query("feature_export", "P4 S11")
def feature_export(t: Tables):
    (players, frame, _), kept = built(t)
    with ordered.bounded_groups([(kept, frames.EPISODE)]):
        out = frames.feature_table(players, frame)
    return out.select("demo_stem", "round_num", "frame", F.size("features").alias("width"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@query(
    "drop_positions",
    "W6 P11 P9",
    f"""WITH {TABLES}, ca AS (SELECT demo_stem, round_num, tick, min({{'slot': slot, 'x': x}}) AS c FROM tk JOIN sl USING (demo_stem, round_num, steamid) WHERE c4 GROUP BY 1, 2, 3),
    s AS (SELECT g.*, coalesce(plant <= tick, false) AS planted, c IS NOT NULL AS carried, c.x / 3000 AS cx, CASE WHEN plant <= tick THEN p.x / 3000 ELSE 0 END AS bx, tick < freeze_end AS fr, tick >= fin AS en FROM gr g JOIN rd USING (demo_stem, round_num) LEFT JOIN ca USING (demo_stem, round_num, tick)),
    e AS (SELECT *, coalesce(lag(carried) OVER w, false) AND NOT carried AND NOT planted AS edge, lag(cx) OVER w AS px FROM s WINDOW w AS (PARTITION BY demo_stem, round_num ORDER BY tick)),
    h AS (SELECT *, count(*) FILTER (edge OR carried OR planted) OVER (PARTITION BY demo_stem, round_num ORDER BY tick) AS grp FROM e),
    v AS (SELECT *, first_value(edge) OVER (PARTITION BY demo_stem, round_num, grp ORDER BY tick) AND grp > 0 AS held, first_value(px) OVER (PARTITION BY demo_stem, round_num, grp ORDER BY tick) AS hx, min(frame) FILTER (NOT fr AND NOT planted AND NOT en) OVER (PARTITION BY demo_stem, round_num) AS lf FROM h)
    SELECT demo_stem, round_num::BIGINT AS round_num, frame, edge AS is_drop, round(CASE WHEN held THEN hx ELSE bx END, 8) AS bomb_x, greatest(0, frame - coalesce(lf, 0)) / 8.0::DOUBLE AS clock FROM v""",
)
def drop_positions(t: Tables):
    (players, frame, _), kept = built(t)
    with ordered.bounded_groups([(kept, frames.EPISODE)]):
        out = frames.reanchored_clock(frames.drop_positions(players, frame))
    return out.select("demo_stem", F.col("round_num").cast("long").alias("round_num"), "frame", "is_drop", F.round("bomb_x", 8).alias("bomb_x"), F.col("round_time_s").alias("clock"))


@query(
    "activity_frames",
    "W1 J3 J4 A1 S1",
    f"""WITH {ACTIVITY}, d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS p FROM activity), f AS (SELECT * EXCLUDE (p), p // 8 AS frame FROM d WHERE p % 8 = 0),
    e AS (SELECT user_id, us, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS code FROM activity WHERE event_type IN ('purchase', 'error')), r AS (SELECT user_id, us FROM activity WHERE event_type = 'error'),
    a AS (SELECT f.*, r.us AS ru FROM f ASOF LEFT JOIN r ON f.user_id = r.user_id AND f.us >= r.us), b AS (SELECT a.*, e.us AS eu, e.code FROM a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.us <= e.us),
    s AS (SELECT user_id, us // 86400000000 AS day, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS bought, count(*) FILTER (event_type = 'click') AS clicks FROM activity GROUP BY 1, 2)
    SELECT b.user_id, event_id, frame, coalesce(least(us - ru, {6 * HOUR}), {6 * HOUR})::BIGINT AS since_error, CASE WHEN eu - us <= {6 * HOUR} THEN code ELSE 2 END::BIGINT AS label, CASE WHEN eu - us <= {6 * HOUR} THEN eu - us ELSE {6 * HOUR} END::BIGINT AS time_to, bought, clicks
    FROM b JOIN s ON s.user_id = b.user_id AND s.day = b.us // 86400000000""",
)
def activity_frames(t: Tables):
    a = t.activity
    kept = windows.keep_every(a, ["user_id"], "us", 8)
    coded = a.filter(F.col("event_type").isin("purchase", "error")).withColumn("code", F.when(F.col("event_type") == "purchase", 0).otherwise(1))
    out = align.since_last(kept, a.filter("event_type = 'error'"), ["user_id"], "us", 6 * HOUR, "since_error")
    out = align.label_next(out, coded, ["user_id"], "us", "code", 6 * HOUR, 2)
    day = F.floor(F.col("us") / 86_400_000_000)
    bought = F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), 4)
    daily = a.groupBy("user_id", day.alias("day")).agg(bought.alias("bought"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    joined = join_on(out.withColumn("day", day), daily, ["user_id", "day"], "inner")
    return joined.select("user_id", "event_id", "frame", "since_error", "label", "time_to", "bought", "clicks")


@query(
    "player_contributions",
    "A2 A23 F8 U3",
    f"""WITH {TABLES}, dm AS (SELECT demo_stem, round_num, l_suppkey % 10 AS attacker, l_partkey % 10 AS victim, l_quantity AS amount, l_linenumber * 40 AS tick FROM li WHERE l_returnflag = 'R'), hit AS (SELECT * FROM dm WHERE attacker <> victim),
    dl AS (SELECT demo_stem, round_num, attacker AS player, sum(amount) AS d FROM hit GROUP BY 1, 2, 3), tp AS (SELECT demo_stem, round_num, max(d) AS m FROM dl GROUP BY 1, 2), de AS (SELECT demo_stem, round_num, victim AS player, min(tick) AS died FROM dm WHERE amount > 40 GROUP BY 1, 2, 3),
    ac AS (SELECT DISTINCT demo_stem, round_num, l_suppkey % 10 AS player FROM li WHERE l_returnflag = 'A' AND l_quantity > 45), lt AS (SELECT demo_stem, round_num, steamid AS player, side, health FROM tk JOIN (SELECT demo_stem, round_num, max(tick) AS tick FROM tk GROUP BY 1, 2) USING (demo_stem, round_num, tick)),
    la AS (SELECT demo_stem, round_num, min(player) AS player FROM lt JOIN rd USING (demo_stem, round_num) WHERE health > 0 AND side = winner GROUP BY 1, 2 HAVING count(*) = 1),
    nm AS (SELECT demo_stem, round_num, attacker AS player FROM hit UNION SELECT demo_stem, round_num, victim FROM hit UNION SELECT demo_stem, round_num, player FROM de UNION SELECT demo_stem, round_num, player FROM lt),
    j AS (SELECT n.*, coalesce(d, 0) AS d, coalesce(m, 1) AS m, greatest(1, fin - freeze_end) AS dur, CASE WHEN died IS NOT NULL THEN greatest(0, died - freeze_end) ELSE greatest(1, fin - freeze_end) END AS surv, ac.player IS NOT NULL OR la.player IS NOT NULL AS obj
      FROM nm n JOIN rd USING (demo_stem, round_num) LEFT JOIN dl USING (demo_stem, round_num, player) LEFT JOIN tp USING (demo_stem, round_num) LEFT JOIN de USING (demo_stem, round_num, player) LEFT JOIN ac ON ac.demo_stem = n.demo_stem AND ac.round_num = n.round_num AND ac.player = n.player LEFT JOIN la ON la.demo_stem = n.demo_stem AND la.round_num = n.round_num AND la.player = n.player)
    SELECT demo_stem, round_num::BIGINT AS round_num, player, d AS damage_dealt, surv::DOUBLE AS survival_time, obj AS objective_action, round(least(greatest(0.4 * least(d / greatest(m, 1), 1) + 0.3 * least(surv / greatest(dur, 1), 1) + CASE WHEN obj THEN 0.3 ELSE 0 END, 0), 1) + 1e-9, 6) AS phi FROM j""",
)
def player_contributions(t: Tables):
    from tickloom.functions import scoring

    c = F.col
    tk = ticks(t)
    dmg = lines(t).filter("l_returnflag = 'R'").select(
        "demo_stem", "round_num", (c("l_suppkey") % 10).alias("attacker"), (c("l_partkey") % 10).alias("victim"), c("l_quantity").alias("amount"), (c("l_linenumber") * 40).alias("tick")
    )
    deaths = dmg.filter("amount > 40").select("demo_stem", "round_num", c("victim").alias("player"), "tick")
    actors = lines(t).filter("l_returnflag = 'A' AND l_quantity > 45").select("demo_stem", "round_num", (c("l_suppkey") % 10).alias("player"))
    last = tk.groupBy(*frames.EPISODE).agg(F.max("tick").alias("tick"))
    present = join_on(tk, last, [*frames.EPISODE, "tick"], "left_semi").select(*frames.EPISODE, c("steamid").alias("player"), "side", "health")
    eps = rounds(t).select(*frames.EPISODE, c("freeze_end").alias("start"), "end", F.lower("winner").alias("winner"))
    out = samples.contributions(dmg, deaths, actors, present, eps, frames.EPISODE)
    phi = scoring.contribution(*[c(x) for x in ("damage_dealt", "max_round_damage", "survival_time", "round_duration", "objective_action")])
    return out.select("demo_stem", c("round_num").cast("long").alias("round_num"), "player", "damage_dealt", "survival_time", "objective_action", F.round(phi + 1e-9, 6).alias("phi"))


@query(
    "movement_directions",
    "P26 A3",
    f"""WITH {TABLES}, en AS (SELECT a.demo_stem, a.round_num, a.tick, a.steamid, avg(b.x) AS ex, count(*) AS n FROM tk a JOIN tk b ON a.demo_stem = b.demo_stem AND a.round_num = b.round_num AND a.tick = b.tick AND a.side <> b.side AND b.health > 0 GROUP BY 1, 2, 3, 4),
    nx AS (SELECT *, lead(x) OVER (PARTITION BY demo_stem, round_num, steamid ORDER BY tick) AS fx FROM tk)
    SELECT demo_stem, round_num::BIGINT AS round_num, tick::BIGINT AS tick, steamid, CASE WHEN fx IS NULL OR ex IS NULL THEN 0 WHEN abs(x - ex) - abs(fx - ex) > 100 THEN 1 WHEN abs(x - ex) - abs(fx - ex) < -100 THEN -1 ELSE 0 END::BIGINT AS move FROM nx LEFT JOIN en USING (demo_stem, round_num, tick, steamid)""",
)
def movement_directions(t: Tables):
    from tickloom.functions import encode

    tk = ticks(t)
    key = [*frames.EPISODE, "tick"]
    means = tk.filter("health > 0").groupBy(*key).agg(*[F.avg(F.when(F.col("side") == s, F.col("X"))).alias(f"m_{s}") for s in ("t", "ct")])
    ahead = ordered.framed(tk, [*frames.EPISODE, "steamid"], "tick", lambda w: {"fx": F.lead("X").over(w)}, before=0, after=1)
    j = join_on(ahead, means, key, "left")
    enemy = F.when(F.col("side") == "t", F.col("m_ct")).otherwise(F.col("m_t"))
    move = encode.approach(F.abs(F.col("X") - enemy), F.abs(F.col("fx") - enemy))
    return j.select("demo_stem", F.col("round_num").cast("long").alias("round_num"), F.col("tick").cast("long").alias("tick"), "steamid", F.coalesce(move, F.lit(0)).cast("long").alias("move"))
