"""Row-wise state queries: every order line is read as one player state.

``states`` derives the state columns from ``lineitem``; ``STATES`` is the same as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import encode, loadout, scoring, text
from tickloom.functions import vocab as V
from tickloom.plans.registry import Tables, query

PRIMARY_POOL = ["AK-47", "AWP", "MP9", "Nova", "Galil AR", "SSG 08"]
SECONDARY_POOL = ["Glock-18", "USP-S", "Desert Eagle"]
UTILITY_POOL = ["Smoke Grenade", "Flashbang", "Molotov", "HE Grenade"]


def sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def sql_map(table: dict) -> str:
    values = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in table.values())
    return f"MAP({sql_list(table)}, [{values}])"


STATES = f"""states AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity,
    CASE l_linestatus WHEN 'O' THEN 'T' ELSE 'CT' END AS player_side, (l_quantity * 2)::BIGINT AS player_health, round(l_tax * 1000)::BIGINT AS player_armor,
    floor(l_extendedprice / 10)::BIGINT AS player_money, l_linenumber % 5 AS alive_teammates, l_suppkey % 6 AS alive_enemies,
    CASE l_returnflag WHEN 'A' THEN 'planted' WHEN 'N' THEN 'carried' ELSE 'dropped' END AS bomb_status,
    CASE WHEN l_discount < 0.015 THEN 'freezetime' WHEN l_returnflag = 'A' THEN 'post-plant' ELSE 'playing' END AS round_phase,
    {sql_list(V.STATE_MAPS)}[l_partkey % 8 + 1] AS map_name, {sql_list(PRIMARY_POOL)}[l_partkey % 7 + 1] AS weapon_primary,
    {sql_list(SECONDARY_POOL)}[l_suppkey % 4 + 1] AS weapon_secondary,
    list_filter({sql_list(UTILITY_POOL)}, lambda u, i: (l_suppkey >> (i - 1)) % 2 = 1) AS utility,
    l_partkey % 3 = 0 AS player_has_helmet, l_suppkey % 5 = 0 AS has_defuser, l_suppkey % 4 AS visible_enemies,
    l_partkey % 13 AS score_t, l_suppkey % 13 AS score_ct, l_partkey % 13 + l_suppkey % 13 + 1 AS round_num FROM lineitem)"""


def at(items, index):
    return F.try_element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))


def states(t: Tables) -> DataFrame:
    c = F.col
    lines = t.lineitem
    has = [F.when(F.shiftright("l_suppkey", i) % 2 == 1, u) for i, u in enumerate(UTILITY_POOL)]
    return lines.select(
        c("l_orderkey").alias("k"),
        c("l_linenumber").cast("long").alias("n"),
        "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity",
        F.when(c("l_linestatus") == "O", "T").otherwise("CT").alias("player_side"),
        (c("l_quantity") * 2).cast("long").alias("player_health"),
        F.round(c("l_tax") * 1000).cast("long").alias("player_armor"),
        F.floor(c("l_extendedprice") / 10).alias("player_money"),
        (c("l_linenumber") % 5).cast("long").alias("alive_teammates"),
        (c("l_suppkey") % 6).cast("long").alias("alive_enemies"),
        F.when(c("l_returnflag") == "A", "planted").when(c("l_returnflag") == "N", "carried").otherwise("dropped").alias("bomb_status"),
        F.when(c("l_discount") < 0.015, "freezetime").when(c("l_returnflag") == "A", "post-plant").otherwise("playing").alias("round_phase"),
        at(V.STATE_MAPS, c("l_partkey") % 8).alias("map_name"),
        at(PRIMARY_POOL, c("l_partkey") % 7).alias("weapon_primary"),
        at(SECONDARY_POOL, c("l_suppkey") % 4).alias("weapon_secondary"),
        F.array_compact(F.array(*has)).alias("utility"),
        (c("l_partkey") % 3 == 0).alias("player_has_helmet"),
        (c("l_suppkey") % 5 == 0).alias("has_defuser"),
        (c("l_suppkey") % 4).alias("visible_enemies"),
        (c("l_partkey") % 13).alias("score_t"),
        (c("l_suppkey") % 13).alias("score_ct"),
        (c("l_partkey") % 13 + c("l_suppkey") % 13 + 1).alias("round_num"),
    )


INV = f"""inv AS (SELECT *, list_concat(CASE WHEN weapon_primary IS NULL THEN [] ELSE [weapon_primary] END, CASE WHEN weapon_secondary IS NULL THEN [] ELSE [weapon_secondary] END, utility,
    CASE WHEN bomb_status = 'carried' AND player_side = 'T' THEN ['C4 Explosive'] ELSE [] END, CASE WHEN l_partkey % 9 = 0 THEN ['StatTrak AK-47'] ELSE ['Karambit'] END) AS inventory FROM states)"""


def inventories(t: Tables) -> DataFrame:
    extra = F.when(F.col("l_partkey") % 9 == 0, "StatTrak AK-47").otherwise("Karambit")
    bomb = F.when((F.col("bomb_status") == "carried") & (F.col("player_side") == "T"), "C4 Explosive")
    inv = F.concat(
        F.array_compact(F.array("weapon_primary", "weapon_secondary")), F.col("utility"), F.array_compact(F.array(bomb, extra))
    )
    return states(t).withColumn("inventory", inv)


@query(
    "encode_numeric",
    "P1 P12",
    """SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, round(l_extendedprice / 3000, 9) AS x, round(sin(radians(l_quantity * 7.2)), 9) AS sin_yaw, round(cos(radians(l_quantity * 7.2)), 9) AS cos_yaw,
      round(greatest(l_quantity - 10, 0) / 100, 9) AS hp, round(ln(1 + greatest(l_extendedprice - 1000, 0)) / 10, 9) AS log_balance, (l_quantity - 10 > 0)::DOUBLE AS alive, round(greatest(l_extendedprice - 1000, 0), 4) AS balance_back FROM lineitem""",
)
def encode_numeric(t: Tables):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"),
        F.col("l_extendedprice").alias("X"), F.lit(None).cast("double").alias("Y"), F.col("l_tax").alias("Z"),
        (F.col("l_quantity") * 7.2).alias("yaw"), F.col("l_tax").alias("pitch"), (F.col("l_quantity") - 10).alias("health"),
        F.col("l_discount").alias("armor"), F.lit(None).cast("boolean").alias("has_helmet"), F.lit(True).alias("has_defuser"),
        (F.col("l_extendedprice") - 1000).alias("balance"), F.col("l_extendedprice").alias("current_equip_value"),
    )
    out = rows.select("k", "n", *[e.alias(n) for n, e in encode.player_features().items()])
    shown = ["x", "sin_yaw", "cos_yaw", "hp", "log_balance"]
    back = F.round(encode.denormalise("log_balance", F.col("log_balance")), 4).alias("balance_back")
    return out.select("k", "n", "alive", back, *[F.round(c, 9).alias(c) for c in shown])


@query(
    "item_category",
    "P2",
    f"""WITH {STATES}, {INV}, u AS (SELECT unnest(inventory) AS item FROM inv)
    SELECT coalesce({sql_map(loadout.CATEGORY_OF)}[item], 'other') AS category, count(*) AS n FROM u GROUP BY 1""",
)
def item_category(t: Tables):
    items = inventories(t).select(F.explode("inventory").alias("item"))
    return items.groupBy(loadout.category(F.col("item")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "loadout_priority",
    "P3",
    f"""WITH {STATES}, {INV}, c AS (SELECT k, n, list_transform(inventory, lambda i: coalesce({sql_map(loadout.CATEGORY_OF)}[i], 'other')) AS cats FROM inv)
    SELECT k, n, coalesce(list_filter({sql_list(V.PRIMARY_ORDER)}, lambda x: list_contains(cats, x))[1], 'other') AS "primary",
      coalesce(list_filter({sql_list(V.SECONDARY_ORDER)}, lambda x: list_contains(cats, x))[1], 'other') AS secondary,
      list_contains(cats, 'c4')::INT::DOUBLE AS has_c4, list_contains(cats, 'smoke')::INT::DOUBLE AS util_smoke, list_contains(cats, 'he')::INT::DOUBLE AS util_he FROM c""",
)
def loadout_priority(t: Tables):
    held = loadout.loadout(F.col("inventory"))
    return inventories(t).select("k", "n", *[held[c].alias(c) for c in ("primary", "secondary", "has_c4", "util_smoke", "util_he")])


@query(
    "feature_vector",
    "P4 A39",
    f"""WITH {STATES}, h AS (SELECT k, n, list_transform(range(8), lambda i: (i = l_partkey % 8)::INT) AS m, list_transform(range(4), lambda i: ((l_suppkey >> i) % 2)) AS u FROM states)
    SELECT k, n, array_to_string(list_concat(m, u), '') AS bits, list_sum(m)::BIGINT AS hot FROM h""",
)
def feature_vector(t: Tables):
    maps = encode.one_hot(encode.index_of(V.STATE_MAPS, F.col("map_name")), len(V.STATE_MAPS))
    util = F.transform(text.words(UTILITY_POOL), lambda u: F.array_contains("utility", u).cast("float"))
    both = F.concat(maps, util)
    hot = F.aggregate(maps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return states(t).select("k", "n", F.array_join(F.transform(both, lambda x: x.cast("int").cast("string")), "").alias("bits"), hot.alias("hot"))


@query(
    "hot_name_roundtrip",
    "P12",
    f"""WITH {STATES} SELECT map_name, count(*) AS n FROM states GROUP BY 1""",
)
def hot_name_roundtrip(t: Tables):
    hot = encode.one_hot(encode.index_of(V.STATE_MAPS, F.col("map_name")), len(V.STATE_MAPS))
    named = states(t).select(encode.hot_name(hot, V.STATE_MAPS).alias("map_name"))
    return named.groupBy("map_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "phase_and_clock",
    "P5 P8 P20",
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_partkey AS tick, 300 AS freeze_end, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey * 10 END AS plant, 1500 + l_linenumber AS fin FROM lineitem)
    SELECT k, n, CASE WHEN tick >= fin THEN 'end' WHEN plant > 0 AND tick >= plant THEN 'post_plant' WHEN tick < freeze_end THEN 'freeze' ELSE 'live' END AS phase,
      greatest(0.0::DOUBLE, (tick - freeze_end) / 64.0::DOUBLE) AS seconds, round(sin(2 * pi() * greatest(0.0::DOUBLE, (tick - freeze_end) / 64.0::DOUBLE) / 5), 8) AS sin_5s,
      (greatest(tick - freeze_end, 0) // 64 // 60)::VARCHAR || ':' || lpad((greatest(tick - freeze_end, 0) // 64 % 60)::VARCHAR, 2, '0') AS clock,
      coalesce(CASE WHEN plant > 0 AND tick - plant BETWEEN 0 AND 40 * 64 THEN '0:' || lpad(floor(40 - (tick - plant) / 64.0::DOUBLE)::BIGINT::VARCHAR, 2, '0') END, '-') AS fuse FROM s""",
)
def phase_and_clock(t: Tables):
    s = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("tick"), F.lit(300).alias("freeze_end"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") * 10).alias("plant"), (1500 + F.col("l_linenumber")).alias("fin"),
    )
    tick, freeze, plant, fin = (F.col(c) for c in ("tick", "freeze_end", "plant", "fin"))
    seconds = encode.round_clock(tick, freeze)
    return s.select(
        "k", "n", encode.phase(tick, freeze, plant, fin).alias("phase"), seconds.alias("seconds"),
        F.round(encode.sinusoids(seconds)["sin_5s"], 8).alias("sin_5s"), encode.clock_text(tick, freeze).alias("clock"),
        F.coalesce(encode.fuse_text(tick, plant), F.lit("-")).alias("fuse"),
    )


SITES = ", ".join(f"('{m}', {c[0]}, {c[1]}, {c[2]}, {c[3]})" for m, c in V.SITE_CENTROIDS.items())
SITE_SQL = f"""centroid(map_name, ax, ay, bx, by_) AS (VALUES {SITES}),
    pl AS (SELECT k, n, map_name, bomb_status, player_side, l_extendedprice / 20 - 2500 AS x, l_partkey * 2.0::DOUBLE - 2000 AS y, CASE WHEN l_suppkey % 2 = 0 THEN -l_quantity * 24 END AS z,
       CASE WHEN l_suppkey % 3 = 0 THEN 'BombsiteB' ELSE 'BombsiteA' END AS label FROM states),
    site AS (SELECT pl.*, CASE WHEN map_name = 'de_nuke' AND z IS NOT NULL THEN CASE WHEN z >= -600 THEN 'a' ELSE 'b' END
        WHEN ax IS NOT NULL THEN CASE WHEN (x - ax) ** 2 + (y - ay) ** 2 <= (x - bx) ** 2 + (y - by_) ** 2 THEN 'a' ELSE 'b' END
        WHEN lower(label) LIKE '%b' THEN 'b' ELSE 'a' END AS site FROM pl LEFT JOIN centroid USING (map_name))"""


def plants(t: Tables) -> DataFrame:
    z = F.when(F.col("l_suppkey") % 2 == 0, -F.col("l_quantity") * 24)
    label = F.when(F.col("l_suppkey") % 3 == 0, "BombsiteB").otherwise("BombsiteA")
    out = states(t).select(
        "k", "n", "map_name", "bomb_status", "player_side", (F.col("l_extendedprice") / 20 - 2500).alias("x"), (F.col("l_partkey") * 2.0 - 2000).alias("y"), z.alias("z"), label.alias("label")
    )
    return out.withColumn("site", encode.nearest_site(*[F.col(c) for c in ("map_name", "x", "y", "z", "label")]))


@query(
    "nearest_site",
    "P6 P7 P10",
    f"""WITH {STATES}, {SITE_SQL} SELECT k, n, site, CASE WHEN bomb_status = 'planted' THEN 'planted_' || site WHEN player_side = 'T' THEN 'carried' ELSE 'none' END AS bomb,
      round(CASE WHEN bomb_status = 'planted' THEN least(sqrt(x * x + y * y), 3000) / 3000 ELSE 1 END, 8) AS gated FROM site""",
)
def nearest_site(t: Tables):
    planted = F.col("bomb_status") == "planted"
    bomb = encode.bomb_state(F.col("player_side") == "T", planted, F.col("site"))
    gated = F.round(encode.gated_distance(planted, F.col("x"), F.col("y")), 8)
    return plants(t).select("k", "n", "site", bomb.alias("bomb"), gated.alias("gated"))


@query(
    "site_cross_check",
    "A33",
    f"""WITH {STATES}, {SITE_SQL} SELECT map_name, count(*) AS plants, count(*) FILTER (site <> CASE WHEN lower(label) LIKE '%b' THEN 'b' ELSE 'a' END) AS disagree FROM site GROUP BY 1""",
)
def site_cross_check(t: Tables):
    labelled = F.when(F.lower("label").endswith("b"), "b").otherwise("a")
    return plants(t).groupBy("map_name").agg(F.count(F.lit(1)).alias("plants"), F.count_if(F.col("site") != labelled).alias("disagree"))


@query(
    "bucket_class",
    "P22 P23 P24",
    """WITH d AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_extendedprice / 100 - 500 AS dx, l_quantity * 10 - 250 AS dy, l_partkey % 41 - 20 AS vx, l_suppkey % 41 - 20 AS vy FROM lineitem),
    e AS (SELECT *, sqrt(dx * dx + dy * dy) AS m, sqrt(vx * vx + vy * vy) AS s, degrees(acos(least(greatest((vx * dx + vy * dy) / (sqrt(vx * vx + vy * vy) * sqrt(dx * dx + dy * dy) + 1e-9), -1), 1))) AS a FROM d)
    SELECT k, n, CASE WHEN m < 8 THEN 0 ELSE 1 + 16 * ((m > 24)::INT + (m > 56)::INT + (m > 120)::INT + (m > 248)::INT + (m > 512)::INT) + (round_even(atan2(dy, dx) / (2 * pi() / 16), 0)::BIGINT % 16 + 16) % 16 END::BIGINT AS class,
      CASE WHEN s < 5 AND m < 25 THEN 0 ELSE 1 + (a > 20)::INT + (a > 60)::INT + (a > 120)::INT END::BIGINT AS turn FROM e""",
)
def bucket_class(t: Tables):
    d = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_extendedprice") / 100 - 500).alias("dx"), (F.col("l_quantity") * 10 - 250).alias("dy"),
        (F.col("l_partkey") % 41 - 20).alias("vx"), (F.col("l_suppkey") % 41 - 20).alias("vy"),
    )
    dx, dy, vx, vy = (F.col(c) for c in ("dx", "dy", "vx", "vy"))
    angle = encode.angle_between(vx, vy, dx, dy)
    turn = encode.turn_bucket(F.sqrt(vx**2 + vy**2), F.sqrt(dx**2 + dy**2), angle)
    return d.select("k", "n", encode.displacement_class(dx, dy).alias("class"), turn.cast("long").alias("turn"))


@query(
    "item_kind",
    "P15 P16 P17",
    f"""WITH {STATES}, {INV}, v AS (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN true ELSE false END AS tagged FROM inv)
    SELECT k, n, coalesce(weapon_primary, CASE WHEN tagged THEN 'StatTrak AK-47' END, '-') AS weapon_primary, coalesce(weapon_secondary, '-') AS weapon_secondary, array_to_string(utility, ',') AS utility,
      CASE weapon_primary WHEN 'AWP' THEN 'awp' WHEN 'AK-47' THEN 'rifle' WHEN 'Galil AR' THEN 'force_rifle' WHEN 'MP9' THEN 'smg_shotgun' WHEN 'Nova' THEN 'smg_shotgun' WHEN 'SSG 08' THEN 'force_angle'
        ELSE CASE WHEN weapon_secondary = 'Desert Eagle' THEN 'force_angle' ELSE 'pistol' END END AS weapon_class,
      (coalesce({sql_map(V.ITEM_PRICES)}[weapon_primary], 0) + coalesce({sql_map(V.ITEM_PRICES)}[weapon_secondary], 0) + CASE WHEN player_armor > 0 THEN 650 + CASE WHEN player_has_helmet THEN 350 ELSE 0 END ELSE 0 END)::BIGINT AS value FROM v""",
)
def item_kind(t: Tables):
    inv = F.col("inventory")
    p = loadout.parsed(inv)
    return inventories(t).select(
        "k", "n", F.coalesce(p["weapon_primary"], F.lit("-")).alias("weapon_primary"), F.coalesce(p["weapon_secondary"], F.lit("-")).alias("weapon_secondary"),
        F.array_join(p["utility"], ",").alias("utility"), loadout.weapon_class(inv).alias("weapon_class"),
        loadout.equipment_value(inv, F.col("player_armor"), F.col("player_has_helmet")).alias("value"),
    )


ECONOMY = f"""worth AS (SELECT k, player_side, player_health, coalesce({sql_map(V.ITEM_PRICES)}[weapon_primary], 0) + coalesce({sql_map(V.ITEM_PRICES)}[weapon_secondary], 0) + CASE WHEN player_armor > 0 THEN 650 + CASE WHEN player_has_helmet THEN 350 ELSE 0 END ELSE 0 END AS v,
      player_health > 20 AS alive FROM states),
    team AS (SELECT k, player_side, sum(v)::BIGINT AS total, count(*) FILTER (alive) AS alive_n, sum(v) FILTER (alive) AS alive_total, count(*) AS players FROM worth GROUP BY 1, 2),
    buy AS (SELECT *, total / alive_n AS avg_all, coalesce(alive_total / alive_n, 0) AS avg_alive FROM team)"""


@query(
    "team_economy",
    "P18 A1",
    f"""WITH {STATES}, {ECONOMY}, l AS (SELECT *, CASE WHEN alive_n = 0 THEN 'eliminated' WHEN avg_all >= 3500 THEN 'full-buy' WHEN avg_all >= 2000 THEN 'half-buy' WHEN avg_all >= 1000 THEN 'force-buy' ELSE 'eco' END AS label,
      CASE WHEN avg_alive >= 3500 THEN 'full' WHEN avg_alive >= 2000 THEN 'half' WHEN avg_alive >= 1000 THEN 'force' ELSE 'eco' END AS short FROM buy),
    p AS (SELECT k, coalesce(max(label) FILTER (player_side = 'T'), 'unknown') AS t_label, coalesce(max(label) FILTER (player_side = 'CT'), 'unknown') AS ct_label, coalesce(max(short) FILTER (player_side = 'T'), 'eco') AS t, coalesce(max(short) FILTER (player_side = 'CT'), 'eco') AS ct FROM l GROUP BY 1)
    SELECT k, t_label, ct_label, CASE WHEN t = ct THEN 'mirror_' || t WHEN {sql_map(V.BUY_STRENGTH)}[t] < {sql_map(V.BUY_STRENGTH)}[ct] THEN t || '_vs_' || ct ELSE ct || '_vs_' || t END AS matchup FROM p""",
)
def team_economy(t: Tables):
    worth = loadout.equipment_value(F.array_compact(F.array("weapon_primary", "weapon_secondary")), F.col("player_armor"), F.col("player_has_helmet"))
    rows = states(t).select("k", "player_side", worth.alias("v"), (F.col("player_health") > 20).alias("alive"))
    aggs = []
    for s in ("T", "CT"):
        mine = F.col("player_side") == s
        aggs += [
            F.count_if(mine).alias(f"{s}_players"), F.sum(F.when(mine, F.col("v")).otherwise(0)).alias(f"{s}_total"),
            F.count_if(mine & F.col("alive")).alias(f"{s}_alive"), F.sum(F.when(mine & F.col("alive"), F.col("v")).otherwise(0)).alias(f"{s}_worth"),
        ]
    g = rows.groupBy("k").agg(*aggs)
    label = {s: loadout.team_buy(F.col(f"{s}_players"), F.col(f"{s}_total"), F.nullif(F.col(f"{s}_alive"), F.lit(0))) for s in ("T", "CT")}
    label = {s: F.when((F.col(f"{s}_players") > 0) & (F.col(f"{s}_alive") == 0), "eliminated").otherwise(v) for s, v in label.items()}
    short = {s: loadout.buy_level(F.coalesce(F.try_divide(F.col(f"{s}_worth"), F.col(f"{s}_alive")), F.lit(0.0))) for s in ("T", "CT")}
    return g.select("k", label["T"].alias("t_label"), label["CT"].alias("ct_label"), loadout.matchup(short["T"], short["CT"]).alias("matchup"))


@query(
    "state_buckets",
    "P19",
    f"""WITH {STATES} SELECT CASE WHEN player_money < 2000 THEN 'eco' WHEN player_money < 3500 THEN 'force-buy' WHEN player_money < 4500 THEN 'half-buy' ELSE 'full-buy' END AS money,
      CASE WHEN player_health >= 90 THEN '>=90' WHEN player_health >= 80 THEN '80-89' WHEN player_health >= 60 THEN '60-79' WHEN player_health >= 40 THEN '40-59' ELSE '<40' END AS hp,
      CASE weapon_primary WHEN 'AWP' THEN 'sniper' WHEN 'SSG 08' THEN 'sniper' WHEN 'AK-47' THEN 'rifle' WHEN 'Galil AR' THEN 'rifle' WHEN 'MP9' THEN 'smg' WHEN 'Nova' THEN 'heavy' ELSE 'pistol_only' END AS weapon,
      CASE WHEN score_t + score_ct + 1 >= 24 THEN 'critical — overtime round' WHEN round_num <= 5 THEN 'early — economy establishment phase'
        WHEN abs(score_t - score_ct) >= 5 THEN 'moderate — ' || CASE WHEN score_t > score_ct THEN 'T-side' ELSE 'CT-side' END || ' has significant lead (' || abs(score_t - score_ct) || ' rounds ahead)'
        WHEN score_t = score_ct THEN 'high — score is tied' ELSE 'elevated — ' || CASE WHEN score_t < score_ct THEN 'T-side' ELSE 'CT-side' END || ' trails by ' || abs(score_t - score_ct) END AS importance, count(*) AS n FROM states GROUP BY ALL""",
)
def state_buckets(t: Tables):
    named = {
        "money": encode.money_bucket(F.col("player_money")), "hp": encode.health_bucket(F.col("player_health")),
        "weapon": encode.weapon_bucket(F.col("weapon_primary")), "importance": encode.round_importance(F.col("score_t"), F.col("score_ct"), F.col("round_num")),
    }
    return states(t).groupBy(*[e.alias(n) for n, e in named.items()]).agg(F.count(F.lit(1)).alias("n"))


@query(
    "raster_position",
    "P21",
    """SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, trunc((l_extendedprice - 3000) / 4.5)::BIGINT AS px, trunc((2500 - l_partkey) / 4.5)::BIGINT AS py FROM lineitem""",
)
def raster_position(t: Tables):
    px, py = encode.raster(F.col("l_extendedprice"), F.col("l_partkey"), F.lit(3000), F.lit(2500), F.lit(4.5))
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), px.alias("px"), py.alias("py"))


@query(
    "state_vectors",
    "P25",
    f"""WITH {STATES} SELECT k, n, (player_side = 'CT')::INT::DOUBLE AS s0, (round_phase = 'post-plant')::INT::DOUBLE AS s1, (map_name = 'de_nuke')::INT::DOUBLE AS s5, (alive_teammates - alive_enemies) / 5.0::DOUBLE AS s10,
      (weapon_primary IS NOT NULL)::INT::DOUBLE AS s11, len(utility) / 4.0::DOUBLE AS s14, CASE bomb_status WHEN 'planted' THEN 0.5 WHEN 'dropped' THEN 1 ELSE 0 END::DOUBLE AS s15, round(alive_teammates / greatest(alive_enemies, 1), 8) AS f3,
      CASE round_phase WHEN 'freezetime' THEN 0 WHEN 'playing' THEN 2 ELSE 3 END::DOUBLE AS f9, CASE bomb_status WHEN 'carried' THEN 0 WHEN 'dropped' THEN 1 ELSE 2 END::DOUBLE AS f10 FROM states""",
)
def state_vectors(t: Tables):
    s, f = encode.state_vector(), encode.structured_vector()
    picks = {f"s{i}": s[i] for i in (0, 1, 5, 10, 11, 14, 15)} | {f"f{i}": f[i] for i in (9, 10)}
    return states(t).select("k", "n", *[e.cast("double").alias(n) for n, e in picks.items()], F.round(f[3], 8).alias("f3"))


BEHAVE = """moved AS (SELECT k, n, player_side, (l_partkey % 3 - 1)::BIGINT AS move, (l_suppkey % 3 - 1)::BIGINT AS goal, list_sort(utility) AS used, l_discount > 0.05 AS initiated, l_tax * 10 AS delay, alive_teammates, alive_enemies, bomb_status, round_phase FROM states)"""


def behaviours(t: Tables) -> DataFrame:
    return states(t).withColumns(
        {
            "movement_direction": F.col("l_partkey") % 3 - 1,
            "objective_direction": F.col("l_suppkey") % 3 - 1,
            "utility_used": F.array_sort("utility"),
            "initiated_engagement": F.col("l_discount") > 0.05,
            "engagement_delay": F.col("l_tax") * 10,
        }
    )


DESCRIBED = """described AS (SELECT *, list_filter([CASE move WHEN 1 THEN 'aggressive' WHEN -1 THEN 'fall_back' ELSE 'hold' END, CASE WHEN goal = 1 AND player_side = 'CT' OR goal = -1 AND player_side = 'T' THEN 'rotate' END,
      CASE WHEN len(used) > 0 THEN 'utility' END, CASE WHEN initiated THEN 'engage' END], lambda x: x IS NOT NULL) AS cats,
    array_to_string(list_filter([CASE move WHEN 1 THEN 'pushed toward enemies' WHEN -1 THEN 'fell back from enemies' ELSE 'held position' END,
      CASE WHEN goal = 1 THEN CASE player_side WHEN 'CT' THEN 'moved toward bomb' ELSE 'stayed near bomb' END WHEN goal = -1 THEN CASE player_side WHEN 'CT' THEN 'moved away from bomb' ELSE 'moved away from planted bomb' END END,
      CASE WHEN len(used) > 0 THEN 'used ' || array_to_string(used, ', ') END, CASE WHEN initiated THEN 'initiated engagement' END], lambda x: x IS NOT NULL), '; ') AS description FROM moved)"""


def described(t: Tables) -> DataFrame:
    rows = behaviours(t)
    said = text.described_action(
        F.col("movement_direction"), F.col("objective_direction"), F.col("utility_used"), F.col("initiated_engagement"), F.lower("player_side")
    )
    return rows.withColumns(said)


@query(
    "described_action",
    "P28",
    f"""WITH {STATES}, {BEHAVE}, {DESCRIBED} SELECT k, n, array_to_string(cats, ',') AS categories, description FROM described""",
)
def described_action(t: Tables):
    return described(t).select("k", "n", F.array_join("categories", ",").alias("categories"), "description")


ADVICE = """adv AS (SELECT *, alive_teammates + 1 AS own, alive_enemies AS foes, CASE WHEN alive_teammates <> 1 THEN 'teammates' ELSE 'teammate' END AS mates FROM states),
    said AS (SELECT *, CASE WHEN bomb_status = 'planted' AND player_side = 'T' THEN own || 'v' || foes || ' post-plant situation, T-side defending planted bomb with ' || alive_teammates || ' ' || mates || ' alive'
        WHEN bomb_status = 'planted' THEN foes || 'v' || own || ' post-plant situation, CT-side rushing defuse with ' || alive_teammates || ' ' || mates || ' alive'
        WHEN round_phase = 'freezetime' THEN 'Freeze time — round about to begin, ' || own || 'v' || foes || ' start'
        WHEN own = foes THEN own || 'v' || foes || ' even fight, bomb ' || bomb_status || ', ' || alive_teammates || ' ' || mates || ' supporting'
        WHEN own > foes THEN own || 'v' || foes || ' man-advantage (+' || (own - foes) || '), bomb ' || bomb_status || ', opportunity to press'
        ELSE own || 'v' || foes || ' man-disadvantage (-' || (foes - own) || '), bomb ' || bomb_status || ', must play carefully' END AS situation,
      CASE WHEN bomb_status = 'planted' AND player_side = 'T' THEN 'Hold passive angle near bomb to deny defuse attempts' WHEN bomb_status = 'planted' AND own >= foes THEN 'Clear site aggressively and secure defuse with teammate cover'
        WHEN bomb_status = 'planted' THEN 'Attempt lone-wolf defuse — distract enemies, fake defuse if needed' WHEN player_health < 50 THEN 'Play defensively — get traded out or fall back for recovery'
        WHEN own > foes + 1 THEN 'Execute coordinated site take with remaining utility' WHEN own = foes THEN 'Hold position and play for picks — look for isolated duels'
        ELSE 'Stall for time — play off-angles and avoid direct confrontation' END AS primary_action,
      CASE WHEN bomb_status = 'planted' AND player_side = 'CT' THEN 'If defuse is impossible, trade kills to deny bomb plant next round economy' WHEN own <= 1 AND foes >= 2 THEN 'If trade opportunity appears, accept it — dying with value is better than losing 1v2+'
        WHEN own > foes THEN 'If execute fails, reset and re-enter from different angle' ELSE 'Fall back to safer position and wait for teammate assistance' END AS fallback FROM adv)"""


@query(
    "templated_advice",
    "P32",
    f"""WITH {STATES}, {ADVICE} SELECT k, n, situation, primary_action, fallback,
      CASE WHEN foes = 0 THEN 'No active threats — round likely decided' ELSE CASE WHEN foes >= 4 THEN 'High enemy count (' || foes || ' active) — multiple angles to watch' WHEN foes >= 2 THEN foes || ' enemies still active — coordinated push possible' ELSE '1 enemy remaining — likely playing for information or time' END
        || CASE WHEN bomb_status = 'planted' THEN CASE player_side WHEN 'CT' THEN '|Bomb planted — time pressure to defuse before detonation' ELSE '|Bomb planted — enemy will attempt defuse, cover site' END ELSE '' END
        || CASE WHEN player_health < 50 THEN '|Low HP (' || player_health || ') — one shot from most weapons is lethal' ELSE '' END END AS threats,
      CASE WHEN alive_teammates = 0 THEN 'Lone survivor: ' || foes || ' remaining — report position via ping' WHEN bomb_status = 'planted' THEN 'Bomb planted — ' || alive_teammates || ' with me, ' || foes || ' enemies. Hold site exits.'
        WHEN own > foes THEN alive_teammates || ' with me, ' || foes || ' enemies. Push together and trade fast.' ELSE alive_teammates || ' with me, ' || foes || ' enemies. Play slow, gather info.' END AS callout,
      'Numbers are ' || own || 'v' || foes || '. Economy is ' || CASE WHEN player_money < 2000 THEN 'eco' WHEN player_money < 3500 THEN 'force-buy' WHEN player_money < 4500 THEN 'half-buy' ELSE 'full-buy' END || ' (' || player_money || ' credits). Weapon loadout: '
        || CASE weapon_primary WHEN 'AWP' THEN 'sniper' WHEN 'SSG 08' THEN 'sniper' WHEN 'AK-47' THEN 'rifle' WHEN 'Galil AR' THEN 'rifle' WHEN 'MP9' THEN 'smg' WHEN 'Nova' THEN 'heavy' ELSE 'pistol_only' END || '.'
        || CASE WHEN bomb_status = 'planted' THEN ' With bomb planted, clock is the primary factor.' WHEN own > foes THEN ' Numerical advantage allows for aggressive plays.' WHEN own < foes THEN ' Numerical disadvantage requires passive, information-based play.' ELSE '' END AS reasoning FROM said""",
)
def templated_advice(t: Tables):
    a = text.advice()
    return states(t).select(
        "k", "n", a["situation_summary"].alias("situation"), a["primary_action"].alias("primary_action"), a["fallback"].alias("fallback"),
        F.array_join(a["immediate_threats"], "|").alias("threats"), a["callout"].alias("callout"), a["reasoning"].alias("reasoning"),
    )


@query(
    "contrast_texts",
    "P33",
    f"""WITH {STATES}, {BEHAVE}, {DESCRIBED}, w AS (SELECT *, alive_teammates + 1 AS own, alive_enemies AS foes, list_contains(cats, 'hold') AS hold, list_contains(cats, 'rotate') AS rot, list_contains(cats, 'engage') AS eng FROM described)
    SELECT k, n, CASE WHEN move = 1 THEN 'Push and look for entry' WHEN rot AND goal > 0 THEN 'Rotate toward the bomb' WHEN rot AND goal < 0 THEN 'Rotate away from the bomb to find a flank angle'
        WHEN hold AND initiated THEN 'Hold your angle but be ready to take a fight if they push' WHEN hold THEN 'Hold your post-plant angle and don''t reposition unnecessarily' WHEN move = -1 THEN 'Disengage and save for the next round' ELSE '?' END
        || '. ' || CASE WHEN own > foes THEN 'You''re up ' WHEN own < foes THEN 'You''re down ' ELSE 'It''s a ' END || own || 'v' || foes
        || CASE WHEN bomb_status = 'planted' THEN '; the bomb is planted, so time pressure is on CT to retake' WHEN round_phase = 'post-plant' AND player_side = 'T' THEN '; you''ve planted, so time is on your side' ELSE '' END
        || CASE WHEN len(used) > 0 THEN '; use your ' || lower(array_to_string(used, ', ')) || ' to support the play' ELSE '' END || '.' AS a_correct,
      CASE WHEN move = 1 THEN 'Stop pushing and pull back to spawn' WHEN hold THEN 'Don''t sit here — rush forward and try to get a pick before they set up' WHEN rot AND goal > 0 THEN 'Stay where you are; don''t rotate toward the bomb, you''ll get traded'
        WHEN rot AND goal < 0 THEN 'Push directly onto the bomb and look for the defuse' WHEN eng AND initiated THEN 'Don''t take a fight here; disengage and play passive' ELSE 'Stop playing passive and force the action' END
        || '. ' || CASE WHEN own > foes THEN 'You''re up ' WHEN own < foes THEN 'You''re down ' ELSE 'It''s a ' END || own || 'v' || foes || '; you have to make something happen, time isn''t on your side.' AS b_opposite FROM w""",
)
def contrast_texts(t: Tables):
    c = text.contrast_texts()
    return described(t).select("k", "n", c["A_correct"].alias("a_correct"), c["B_anti_pro"].alias("b_opposite"))


@query(
    "state_briefing",
    "",
    f"""WITH {STATES} SELECT k, n, md5('Map: ' || replace(map_name, 'de_', '') || chr(10) || 'Phase: ' || round_phase || chr(10) || 'Your side: ' || player_side || chr(10) || 'Your health: ' || player_health || ' | armor: ' || player_armor || chr(10)
      || 'Your money: $' || player_money || chr(10) || 'Your weapons: ' || coalesce(weapon_primary, '?') || ' / ' || coalesce(weapon_secondary, '?') || chr(10) || 'Your utility: ' || CASE WHEN len(utility) > 0 THEN array_to_string(utility, ', ') ELSE 'none' END || chr(10)
      || 'Teammates alive (incl. you): ' || alive_teammates || chr(10) || 'Enemies alive: ' || alive_enemies || chr(10) || 'Bomb: ' || bomb_status || chr(10) || 'Enemies currently visible to you: ' || visible_enemies) AS digest FROM states""",
)
def state_briefing(t: Tables):
    return states(t).select("k", "n", F.md5(text.briefing()).alias("digest"))


def sql_hits(column: str, words) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains(lower({column}), w)))"


def sql_groups(column: str, groups) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {sql_hits(column, ws)} > 0 THEN '{g}' END" for g, ws in groups.items()) + "], lambda x: x IS NOT NULL))"


READ = f"""heard AS (SELECT *, primary_action || ' ' || fallback AS txt FROM said),
    counted AS (SELECT k, n, txt, {sql_hits('txt', V.ADVANCE_WORDS)} AS a, {sql_hits('txt', V.RETREAT_WORDS)} AS r, {sql_hits('txt', V.HOLD_WORDS)} AS h, {sql_hits('txt', V.TOWARD_WORDS)} AS tw, {sql_hits('txt', V.AWAY_WORDS)} AS aw,
      {sql_hits('txt', V.INITIATE_WORDS)} AS s, {sql_hits('txt', V.WAIT_WORDS)} AS w, {sql_groups('txt', V.UTILITY_WORDS)} AS util, {sql_groups('txt', V.ACTION_WORDS)} AS cats FROM heard),
    behaved AS (SELECT k, n, txt, util, cats, CASE WHEN greatest(a, r, h) = 0 THEN NULL WHEN a >= r AND a >= h THEN 1 WHEN r >= h THEN -1 ELSE 0 END AS mv, CASE WHEN tw > aw THEN 1 WHEN aw > tw THEN -1 WHEN tw > 0 THEN 0 END AS ob,
      CASE WHEN s > w THEN true WHEN w > s THEN false END AS st FROM counted)"""


def heard(t: Tables) -> DataFrame:
    a = text.advice()
    said = F.concat_ws(" ", a["primary_action"], a["fallback"])
    return behaviours(t).withColumn("txt", said)


@query(
    "keyword_direction",
    "P29 P41 E6",
    f"""WITH {STATES}, {ADVICE}, {READ} SELECT k, n, coalesce(mv, 9)::BIGINT AS movement, coalesce(ob, 9)::BIGINT AS objective, array_to_string(util, ',') AS utility, array_to_string(cats, ',') AS categories,
      coalesce(CASE WHEN st THEN 0.2 WHEN NOT st THEN 0.8 END, 0.5)::DOUBLE AS delay FROM behaved""",
)
def keyword_direction(t: Tables):
    read = text.read_once(heard(t).select("k", "n", "txt"), "txt", lambda texts: text.with_categories(text.with_behaviour(texts, "txt", "b"), "txt"))
    return read.select(
        "k", "n", F.coalesce("b.movement_direction", F.lit(9)).cast("long").alias("movement"), F.coalesce("b.objective_direction", F.lit(9)).cast("long").alias("objective"),
        F.array_join("b.utility_used", ",").alias("utility"), F.array_join("categories", ",").alias("categories"), scoring.judge_score(F.col("b.engagement_delay")).alias("delay"),
    )


TALK = {"advance": ["the ", "die ", "und", "le "], "retreat": ["la ", "ein", "on "], "hold": ["de ", "ing", "ung"]}


@query(
    "keyword_conversations",
    "P29",
    f"""WITH c AS (SELECT conv_id, turn, {sql_hits('text', TALK['advance'])} AS a, {sql_hits('text', TALK['retreat'])} AS r, {sql_hits('text', TALK['hold'])} AS h FROM conversations)
    SELECT conv_id, turn, CASE WHEN greatest(a, r, h) = 0 THEN 9 WHEN a >= r AND a >= h THEN 1 WHEN r >= h THEN -1 ELSE 0 END::BIGINT AS movement FROM c""",
)
def keyword_conversations(t: Tables):
    out = text.with_movement(t.conversations, "text", **TALK)
    return out.select("conv_id", "turn", F.coalesce("movement", F.lit(9)).cast("long").alias("movement"))


@query(
    "light_keywords",
    "P29 A20",
    f"""WITH {STATES}, {ADVICE}, heard AS (SELECT k, n, primary_action || ' ' || fallback AS txt FROM said), c AS (SELECT k, n, {sql_hits('txt', V.LIGHT_ADVANCE)} AS a, {sql_hits('txt', V.LIGHT_RETREAT)} AS r, {sql_hits('txt', V.LIGHT_HOLD)} AS h,
      {sql_hits('txt', V.LIGHT_TOWARD)} AS tw, {sql_hits('txt', V.LIGHT_AWAY)} AS aw, {sql_hits('txt', V.LIGHT_UTILITY)} AS u, {sql_hits('txt', V.LIGHT_INITIATE)} > {sql_hits('txt', V.LIGHT_WAIT)} AS st FROM heard)
    SELECT k, n, CASE WHEN greatest(a, r, h) = 0 THEN 0 WHEN a >= r AND a >= h THEN 1 WHEN r >= h THEN -1 ELSE 0 END::DOUBLE AS v0, CASE WHEN tw > aw THEN 1 WHEN aw > tw THEN -1 ELSE 0 END::DOUBLE AS v1, least(u, 4) / 4.0::DOUBLE AS v2, st::INT::DOUBLE AS v3, CASE WHEN st THEN 0.2 ELSE 0.8 END::DOUBLE AS v4 FROM c""",
)
def light_keywords(t: Tables):
    b = text.with_behaviour(heard(t).select("k", "n", "txt"), "txt", "b", light=True)
    v = encode.action_vector(*[F.col(f"b.{f}") for f in ("movement_direction", "objective_direction", "utility_count", "initiated_engagement", "engagement_delay")])
    return b.select("k", "n", *[e.alias(f"v{i}") for i, e in enumerate(v)])


@query(
    "behaviour_alignment",
    "A22 A23",
    f"""WITH {STATES}, {ADVICE}, heard AS (SELECT *, primary_action || ' ' || fallback AS txt, (l_partkey % 3 - 1)::BIGINT AS move, (l_suppkey % 3 - 1)::BIGINT AS goal, list_filter(['flash', 'he', 'molotov', 'smoke'], lambda x, i: (l_suppkey >> (i - 1)) % 2 = 1) AS used, l_discount > 0.05 AS initiated, l_tax * 10 AS delay FROM said),
    c AS (SELECT *, {sql_hits('txt', V.ADVANCE_WORDS)} AS a, {sql_hits('txt', V.RETREAT_WORDS)} AS r, {sql_hits('txt', V.HOLD_WORDS)} AS h, {sql_hits('txt', V.TOWARD_WORDS)} AS tw, {sql_hits('txt', V.AWAY_WORDS)} AS aw, {sql_hits('txt', V.INITIATE_WORDS)} AS s, {sql_hits('txt', V.WAIT_WORDS)} AS w, {sql_groups('txt', V.UTILITY_WORDS)} AS util FROM heard),
    b AS (SELECT *, CASE WHEN greatest(a, r, h) = 0 THEN NULL WHEN a >= r AND a >= h THEN 1 WHEN r >= h THEN -1 ELSE 0 END AS mv, CASE WHEN tw > aw THEN 1 WHEN aw > tw THEN -1 WHEN tw > 0 THEN 0 END AS ob, CASE WHEN s > w THEN true WHEN w > s THEN false END AS st FROM c),
    g AS (SELECT *, list_filter([CASE WHEN mv IS NOT NULL THEN (mv = move)::INT::DOUBLE END, CASE WHEN ob IS NOT NULL THEN (ob = goal)::INT::DOUBLE END,
        CASE WHEN len(used) = 0 AND len(util) = 0 THEN 1 ELSE len(list_intersect(used, util)) / len(list_distinct(list_concat(used, util))) END::DOUBLE, CASE WHEN st IS NOT NULL THEN (st = initiated)::INT::DOUBLE END,
        CASE WHEN st IS NOT NULL THEN CASE WHEN abs(CASE WHEN st THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END - delay) <= 0.2 THEN 1 ELSE greatest(0, 1 - (abs(CASE WHEN st THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END - delay) - 0.2) / 0.3) END END], lambda x: x IS NOT NULL) AS scores FROM b),
    f AS (SELECT *, list_sum(scores) / len(scores) AS al, least(greatest(0.4 * least(l_quantity / 50, 1) + 0.3 * least(l_extendedprice / 100000, 1) + 0.3 * (l_partkey % 4 = 0)::INT, 0), 1) AS phi, player_side = 'T' AS won FROM g)
    SELECT k, n, round(al, 7) AS alignment, round(phi, 9) AS phi, round(1e-9 + al * least(greatest(phi * CASE WHEN won THEN 0.5 + 0.5 * al ELSE 0.5 - 0.3 * al END, 0), 1), 6) AS outcome, round(CASE WHEN won THEN al ELSE 1 - al END, 7) AS simple FROM f""",
)
def behaviour_alignment(t: Tables):
    short = ["flash", "he", "molotov", "smoke"]
    used = F.array_compact(F.array(*[F.when(F.shiftright("l_suppkey", i) % 2 == 1, u) for i, u in enumerate(short)]))
    rows = heard(t).withColumn("utility_used", used)
    truth = F.struct("movement_direction", "objective_direction", "utility_used", "initiated_engagement", "engagement_delay")
    one = text.read_once(rows, "txt", lambda texts: text.with_behaviour(texts, "txt", "model")).withColumns({"truth": truth, "won": F.col("player_side") == "T"})
    one = scoring.with_alignment(one, "model", "truth", "al")
    phi = scoring.contribution(F.col("l_quantity"), F.lit(50.0), F.col("l_extendedprice"), F.lit(100000.0), F.col("l_partkey") % 4 == 0)
    one = one.withColumn("phi", phi)
    return one.select(
        "k", "n", F.round("al", 7).alias("alignment"), F.round("phi", 9).alias("phi"),
        F.round(scoring.outcome(F.col("won"), F.col("phi"), F.col("al")) + 1e-9, 6).alias("outcome"), F.round(scoring.simple_outcome(F.col("won"), F.col("al")), 7).alias("simple"),
    )


@query(
    "field_scoring",
    "A21 E1",
    f"""WITH {STATES}, p AS (SELECT *, round(player_health * (0.8 + l_discount * 4)) AS hp, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE player_armor END AS ar, round(player_money * (0.9 + l_tax * 2)) AS mo,
      CASE WHEN l_suppkey % 2 = 0 THEN lower(weapon_primary) ELSE 'AK-47' END AS wp, CASE WHEN l_partkey % 2 = 0 THEN lower(player_side) ELSE 'T' END AS sd, utility[1:2] AS ut FROM states),
    s AS (SELECT k, n, CASE WHEN player_health = 0 THEN (hp = 0)::INT ELSE CASE WHEN abs(hp - player_health) / player_health <= 0.1 THEN 1 ELSE greatest(0, 1 - (abs(hp - player_health) / player_health - 0.1) / 0.1) END END AS s1,
      CASE WHEN ar IS NULL THEN 0 ELSE 1 END AS s2, CASE WHEN player_money = 0 THEN (mo = 0)::INT WHEN abs(mo - player_money) / player_money <= 0.1 THEN 1 ELSE greatest(0, 1 - (abs(mo - player_money) / player_money - 0.1) / 0.1) END AS s3,
      CASE WHEN weapon_primary IS NULL AND wp IS NULL THEN 1 WHEN weapon_primary IS NULL OR wp IS NULL THEN 0 ELSE (lower(weapon_primary) = lower(wp))::INT END AS s4, (lower(sd) = lower(player_side))::INT AS s5,
      CASE WHEN len(utility) = 0 THEN 1 ELSE len(ut) / len(utility) END AS s6 FROM p)
    SELECT k, n, round((s1 + s2 + s4 + s6) / 4.0, 7) AS visual, round((s3 + s5) / 2.0, 7) AS context, round((s1 + s2 + s3 + s4 + s5 + s6) / 6.0, 7) AS combined, round(0.7 * (s1 + s2 + s4 + s6) / 4.0 + 0.3 * (s3 + s5) / 2.0, 7) AS weighted FROM s""",
)
def field_scoring(t: Tables):
    guess = {
        "player_health": F.round(F.col("player_health") * (0.8 + F.col("l_discount") * 4)),
        "player_armor": F.when(F.col("l_partkey") % 5 != 0, F.col("player_armor")),
        "player_money": F.round(F.col("player_money") * (0.9 + F.col("l_tax") * 2)),
        "weapon_primary": F.when(F.col("l_suppkey") % 2 == 0, F.lower("weapon_primary")).otherwise("AK-47"),
        "player_side": F.when(F.col("l_partkey") % 2 == 0, F.lower("player_side")).otherwise("T"),
        "utility": F.slice("utility", 1, 2),
    }
    rows = states(t).withColumns({f"p_{f}": e for f, e in guess.items()})
    scored, (visual, context) = scoring.with_field_scores(rows, [V.VISUAL_FIELDS, V.CONTEXT_FIELDS], lambda f: F.col(f"p_{f}"), F.col, list(guess))
    return scored.select("k", "n", *[F.round(e, 7).alias(n) for n, e in scoring.split_score(visual, context).items()])


@query(
    "json_from_text",
    "P30 A23",
    """WITH r AS (SELECT event_id, event_type, regexp_extract(props, '\\d+')::BIGINT AS k FROM events)
    SELECT event_id, CASE event_type WHEN 'click' THEN k WHEN 'view' THEN k WHEN 'purchase' THEN k ELSE -1 END AS k, CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END::DOUBLE AS gate FROM r""",
)
def json_from_text(t: Tables):
    state = F.concat(F.lit('{"game_state": '), F.col("props"), F.lit(', "analysis": {}, "advice": {}}'))
    reply = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Sure:\n```json\n"), state, F.lit("\n```\nDone {ok")))
        .when(F.col("event_type") == "view", F.concat(F.lit("I read "), state, F.lit(" there.")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('out {"game_state": '), F.col("props"), F.lit("}")))
        .when(F.col("event_type") == "error", F.concat(F.lit("broken {"), F.col("props")))
        .otherwise("no object")
    )
    found = text.json_object(reply)
    k = F.coalesce(F.get_json_object(found, "$.game_state.k").cast("long"), F.lit(-1))
    return t.events.select("event_id", k.alias("k"), text.format_gate(reply).alias("gate"))


@query(
    "canonical_json",
    "P40",
    f"""WITH {STATES} SELECT k, n, '{{"alive_enemies":' || alive_enemies || ',"bomb_status":"' || bomb_status || '","player_health":' || player_health || ',"weapon_primary":' || coalesce('"' || weapon_primary || '"', 'null') || '}}' AS j FROM states""",
)
def canonical_json(t: Tables):
    names = ["weapon_primary", "player_health", "visible_enemies", "bomb_status", "alive_enemies", "round_num"]
    return states(t).select("k", "n", text.canonical_json({c: F.col(c) for c in names}, drop=V.DROPPED_FIELDS).alias("j"))


@query(
    "percent_from_text",
    "P36",
    """SELECT event_id, coalesce(nullif(regexp_extract('CT at ' || CASE WHEN event_type = 'error' THEN 'even odds' ELSE value::VARCHAR || ' % now, then 12%' END, '(\\d+(?:\\.\\d+)?)\\s*%', 1), '')::DOUBLE, -1) AS pct FROM events""",
)
def percent_from_text(t: Tables):
    said = F.concat(F.lit("CT at "), F.when(F.col("event_type") == "error", "even odds").otherwise(F.concat(F.col("value").cast("string"), F.lit(" % now, then 12%"))))
    return t.events.select("event_id", F.coalesce(text.percent(said), F.lit(-1.0)).alias("pct"))


@query(
    "canonical_pair_name",
    "P14",
    """WITH s AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE replace(lower(p_brand), '#', '-') || '-vs-' || lower(p_type) || '-m' || p_size || '-' || split_part(p_name, ' ', 2) END AS stem, replace(lower(p_brand), '#', '-') AS a, lower(p_type) AS b, p_size, p_name FROM part)
    SELECT p_partkey::BIGINT AS part, CASE WHEN p_size % 5 = 0 THEN stem ELSE least(a, b) || '-vs-' || greatest(a, b) || '-m' || p_size || '-' || split_part(p_name, ' ', 2) END AS canonical,
      CASE WHEN p_size % 5 = 0 THEN stem ELSE CASE least(a, b) || '-vs-' || greatest(a, b) WHEN 'brand-2-vs-economy' THEN 'fixed' ELSE least(a, b) || '-vs-' || greatest(a, b) END END AS pair FROM s""",
)
def canonical_pair_name(t: Tables):
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))
    stem = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(
        F.concat(brand, F.lit("-vs-"), F.lower("p_type"), F.lit("-m"), F.col("p_size").cast("string"), F.lit("-"), F.split_part("p_name", F.lit(" "), F.lit(2)))
    )
    rows = t.part.select(F.col("p_partkey").cast("long").alias("part"), stem.alias("stem"))
    return rows.select("part", text.unordered_pair(F.col("stem")).alias("canonical"), text.team_key(F.col("stem"), {"brand-2-vs-economy": "fixed"}).alias("pair"))


@query(
    "conversation_rows",
    "P39 P40",
    """WITH a AS (SELECT c.conv_id, c.turn, c.text, n.text AS answer FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 AND n.role = 'assistant' WHERE c.role = 'user')
    SELECT conv_id, turn, CASE WHEN answer IS NULL THEN 2 ELSE 3 END::BIGINT AS n_messages, md5(text) AS prompt, coalesce(md5(answer), '-') AS answer FROM a""",
)
def conversation_rows(t: Tables):
    c = t.conversations
    replies = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    asked = c.filter("role = 'user'").join(replies, ["conv_id", "turn"], "left")
    images = F.array(F.format_string("img-%d-%d.png", "conv_id", "turn"))
    without, withal = text.messages(F.lit("system"), images, F.col("text")), text.messages(F.lit("system"), images, F.col("text"), F.col("answer"))
    rows = asked.withColumn("messages", F.when(F.col("answer").isNull(), without).otherwise(withal))
    blocks = F.transform(F.col("messages")[1]["content"], lambda b: F.struct(b["type"].alias("type"), b["value"].alias("text")))
    return rows.select(
        "conv_id", "turn", F.size("messages").cast("long").alias("n_messages"), F.md5(text.block_text(blocks)).alias("prompt"),
        F.coalesce(F.md5(F.try_element_at("messages", F.lit(3))["content"][0]["value"]), F.lit("-")).alias("answer"),
    )


def sql_pick(options, key: str) -> str:
    """One of the options by the SHA-256 of ``key``, as ``text.picked`` chooses."""
    return f"[{', '.join(options)}][(('0x' || sha256({key})[1:8])::BIGINT % {len(options)} + 1)::INT]"


def sql_phrase(*options: str) -> str:
    return sql_pick(options, "k || ':' || n || ':1'")


TEAM = {
    "still": sql_pick(["'CT to hold position'", "'CT to stay put'"], "k || ':' || n || ':CT:3'"),
    "push": sql_pick(["'a coordinated CT push (' || m || ' players)'", "m || ' CT players pushing together'"], "k || ':' || n || ':CT:3'"),
    "spread": sql_pick(["m || ' CT players pushing from spread positions'", "'scattered fast movement from ' || m || ' CT players'"], "k || ':' || n || ':CT:3'"),
    "few": sql_pick(["alive_teammates || ' ' || noun || ' repositioning'", "alive_teammates || ' ' || noun || ' on the move'"], "k || ':' || n || ':CT:3'"),
}


@query(
    "foresight_phrases",
    "P35",
    f"""WITH {STATES}, b AS (SELECT *, l_quantity * 2 AS now, l_quantity * 2 + l_discount * 100 - 5 AS later, alive_teammates + 1 AS m, CASE WHEN alive_teammates > 1 THEN 'CT players' ELSE 'CT player' END AS noun,
      list_transform(range(1, alive_teammates + 2), lambda i: (i * l_partkey % 16) * 0.39269908169872414) AS turns FROM states),
    e AS (SELECT *, abs(now - 50) AS edge, CASE WHEN now >= 50 THEN 'CT' ELSE 'T' END AS side, CASE WHEN later > now THEN 'edge up slightly' ELSE 'soften slightly' END AS drift,
      sqrt(list_avg(list_transform(turns, lambda x: cos(x))) ** 2 + list_avg(list_transform(turns, lambda x: sin(x))) ** 2) AS together FROM b)
    SELECT k, n, CASE WHEN edge < 6 THEN {sql_phrase("'the round is roughly even'", "'this is close to a coin-flip'", "'neither side holds a clear edge'")}
        WHEN edge < 18 THEN {sql_phrase("side || ' is modestly favoured'", "side || ' holds a slight edge'", "'the model leans ' || side")}
        ELSE {sql_phrase("side || ' is in a strong position'", "side || ' is clearly favoured'", "'the model reads this as a ' || side || '-sided round'")} END
      || printf(' (CT win probability ~%.0f%%)', now) || '.' || CASE WHEN abs(later - now) < 3 THEN '' ELSE
        {sql_pick(["' The model expects CT''s read to ' || drift || ' over the next few seconds.'", "' Over the next few seconds the model sees this ' || drift || '.'"], "k || ':' || n || ':2'")} END
      || ' The model expects ' || CASE WHEN alive_teammates = 0 THEN {TEAM["still"]} WHEN m >= 2 AND together > 0.6 THEN {TEAM["push"]} WHEN m >= 2 THEN {TEAM["spread"]} ELSE {TEAM["few"]} END || '.' AS target FROM e""",
)
def foresight_phrases(t: Tables):
    key = [F.col("k"), F.col("n")]
    now, later = F.col("l_quantity") * 2, F.col("l_quantity") * 2 + F.col("l_discount") * 100 - 5
    bearings = F.transform(F.sequence(F.lit(1), F.col("alive_teammates") + 1), lambda i: (i * F.col("l_partkey") % 16) * 0.39269908169872414)
    return states(t).select(
        "k", "n", F.concat(text.value_phrase(now, *key), F.lit("."), text.trend_phrase(now, later, *key), F.lit(" The model expects "), text.team_clause("CT", F.col("alive_teammates"), bearings, *key), F.lit(".")).alias("target")
    )


@query(
    "coverage_grid_gaps",
    "A4 U4",
    f"""WITH {STATES}, c AS (SELECT alive_teammates AS a, alive_enemies AS e, count(*) AS n FROM states GROUP BY 1, 2), g AS (SELECT a, e FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(7)) AS e))
    SELECT 'cell' AS kind, a || 'v' || e AS bucket, n FROM c UNION ALL SELECT 'gap', a || 'v' || e, 0 FROM g LEFT JOIN c USING (a, e) WHERE n IS NULL
    UNION ALL SELECT 'bomb', bomb_status, count(*) FROM states GROUP BY 2 UNION ALL SELECT 'few', a || 'v' || e, n FROM c WHERE n < 2000""",
)
def coverage_grid_gaps(t: Tables):
    from tickloom.operators.quality import coverage

    return coverage(states(t), {"cell": ["alive_teammates", "alive_enemies"], "bomb": ["bomb_status"]}, grid=("cell", [range(6), range(7)]), few=2000)


@query(
    "curate_with_cap",
    "F10 T3",
    f"""WITH {STATES}, r AS (SELECT *, CASE WHEN alive_teammates + alive_enemies < 9 OR bomb_status = 'planted' OR player_health < 80 OR NOT (alive_teammates = 4 AND alive_enemies = 5 AND player_health >= 90) THEN 'keep' ELSE 'pool' END AS c,
      sha256(k || '#' || n || '#' || l_partkey || '#' || l_suppkey || '#' || l_quantity::BIGINT || '#42') AS h FROM states),
    p AS (SELECT * FROM r WHERE c = 'pool' ORDER BY h LIMIT 50)
    SELECT c AS reason, k, n FROM r WHERE c = 'keep' UNION ALL SELECT c, k, n FROM p""",
)
def curate_with_cap(t: Tables):
    from tickloom.operators.splits import curate, fallen, planted, weakened

    rows = states(t)
    full = (F.col("alive_teammates") == 4) & (F.col("alive_enemies") == 5) & (F.col("player_health") >= 90)
    key = [F.col("k"), F.col("n"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")]
    return curate(rows, fallen() | planted() | weakened() | ~full, key, cap=50, seed=42).select("reason", "k", "n")


@query(
    "sample_manifest",
    "A30",
    f"""WITH {STATES} SELECT count(DISTINCT (k)) AS rounds, count(*) AS samples, count(*) FILTER (player_side = 'T') AS n_t, count(*) FILTER (player_side = 'CT') AS n_ct,
      round(count(*) FILTER (player_side = 'T' AND l_partkey % 2 = 0) / count(*) FILTER (player_side = 'T'), 4) AS rate_t, round(count(*) FILTER (player_side = 'CT' AND l_partkey % 2 = 0) / count(*) FILTER (player_side = 'CT'), 4) AS rate_ct FROM states""",
)
def sample_manifest(t: Tables):
    rows = states(t).withColumn("won", F.col("l_partkey") % 2 == 0)
    side = {s: F.lower("player_side") == s for s in ("t", "ct")}
    counts = [F.count_if(c).alias(f"n_{s}") for s, c in side.items()] + [F.count_if(c & F.col("won")).alias(f"w_{s}") for s, c in side.items()]
    per_round = rows.groupBy("k").agg(F.count(F.lit(1)).alias("samples"), *counts)
    total = per_round.agg(F.count(F.lit(1)).alias("rounds"), *[F.sum(c).alias(c) for c in ("samples", "n_t", "n_ct", "w_t", "w_ct")])
    return total.select("rounds", "samples", "n_t", "n_ct", *[F.round(F.col(f"w_{s}") / F.greatest(F.col(f"n_{s}"), F.lit(1)), 4).alias(f"rate_{s}") for s in ("t", "ct")])


@query(
    "ablated_features",
    "P13",
    f"""WITH {STATES} SELECT round(sum(l_extendedprice), 2) AS x, 0.0::DOUBLE AS score_t, 0.0::DOUBLE AS round_num, sum(player_health)::DOUBLE AS hp FROM states""",
)
def ablated_features(t: Tables):
    named = states(t).select(
        F.col("l_extendedprice").alias("x"), F.col("score_t").cast("double"), F.col("round_num").cast("double"), F.col("player_health").cast("double").alias("hp")
    )
    return encode.ablate(named, encode.ABLATIONS["no_bookkeeping"]).agg(F.round(F.sum("x"), 2).alias("x"), *[F.sum(c).alias(c) for c in ("score_t", "round_num", "hp")])


@query(
    "priority_pick",
    "P3 P16",
    """WITH d AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, list(event_type) AS types FROM events GROUP BY 1, 2)
    SELECT user_id, day::BIGINT AS day, coalesce(list_filter(['purchase', 'signup', 'click'], lambda x: list_contains(types, x))[1], 'other') AS top FROM d""",
)
def priority_pick(t: Tables):
    day = F.floor(F.col("us") / 86_400_000_000)
    types = t.activity.groupBy("user_id", day.alias("day")).agg(F.collect_set("event_type").alias("types"))  # at most one entry per type
    return types.select("user_id", "day", loadout.first_held(F.col("types"), ["purchase", "signup", "click"]).alias("top"))
