"""Stored, ordered blocks: vector lookups by time key, and the context text of a sample."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import vocab as V
from tickloom.operators import blocks, context
from tickloom.plans.recordings import EP, MAPS, TABLES, header, kept_ticks, lines, rounds
from tickloom.plans.registry import Tables, query
from tickloom.session import scratch


def store_name(what: str) -> str:
    """A table name of this run; stores of one session never meet."""
    return f"{what}_{uuid.uuid4().hex[:12]}"


VECTORS = "vec_id % 7 AS demo, label AS round_num, vec_id // 7 * 5 AS tick"


@query(
    "vector_lookup",
    "J23",
    f"""WITH c AS (SELECT {VECTORS}, min(embedding) AS embedding FROM embeddings GROUP BY ALL),
    b AS (SELECT event_id, user_id % 9 AS demo, event_id % 12 AS round_num, floor(value * 7)::BIGINT AS tick FROM events),
    h AS (SELECT b.event_id, arg_min(embedding, (abs(c.tick - b.tick), c.tick)) AS v FROM b JOIN c USING (demo, round_num) GROUP BY 1)
    SELECT event_id, v IS NOT NULL AS found, len(coalesce(v, list_resize([]::FLOAT[], (SELECT max(len(embedding)) FROM embeddings), 0)))::BIGINT AS size, coalesce(v[1], 0)::DOUBLE AS first, coalesce(v[-1], 0)::DOUBLE AS last
    FROM b LEFT JOIN h USING (event_id)""",
)
def vector_lookup(t: Tables):
    """Cached vectors nearest to (demo, round, tick) keys; every event is one lookup, some of unknown rounds."""
    c = F.col
    cache = t.embeddings.select((c("vec_id") % 7).alias("demo"), c("label").cast("long").alias("round_num"), (F.floor(c("vec_id") / 7) * 5).alias("tick"), "embedding")
    store = blocks.store_blocks(cache, store_name("vectors"), ["demo", "round_num"], "tick", ["embedding"], tie=None, path=scratch(t.spark, "vectors"))
    size = t.embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    batch = t.events.select("event_id", (c("user_id") % 9).alias("demo"), (c("event_id") % 12).alias("round_num"), F.floor(c("value") * 7).alias("at"))
    out = store.lookup_batch(batch, "at", "embedding", size)
    edge = [F.element_at("embedding", i).cast("double").alias(n) for n, i in (("first", 1), ("last", -1))]
    return out.select("event_id", "found", F.size("embedding").cast("long").alias("size"), *edge)


def events_of(t: Tables) -> DataFrame:
    """Deaths and bomb changes of the order lines: ``demo_stem, round_num, tick, kind, player, side``."""
    c = F.col
    player = (c("l_suppkey") % 10).cast("long")
    at = (c("l_linenumber") * 40 + c("l_partkey") % 40).cast("int").alias("tick")
    deaths = lines(t).filter("l_returnflag = 'R'").select("demo_stem", "round_num", at, F.lit("death").alias("kind"), F.concat(F.lit("p"), player.cast("string")).alias("player"), F.when(player < 5, "t").otherwise("ct").alias("side"))
    change = F.element_at(F.array(*[F.lit(e) for e in ("plant", "drop", "pickup", "defuse")]), (c("l_suppkey") % 4 + 1).cast("int"))
    bombs = lines(t).filter("l_returnflag = 'A'").select("demo_stem", "round_num", at, change.alias("kind"), F.lit(None).cast("string").alias("player"), F.lit(None).cast("string").alias("side"))
    return deaths.unionByName(bombs)


ECONOMY = "CASE WHEN n IS NULL THEN 'unknown' WHEN alive = 0 THEN 'eliminated' WHEN worth / alive >= 3500 THEN 'full-buy' WHEN worth / alive >= 2000 THEN 'half-buy' WHEN worth / alive >= 1000 THEN 'force-buy' ELSE 'eco' END"
PRICES = " + ".join(
    f"CASE WHEN {test} THEN {V.ITEM_PRICES.get(item, 0)} ELSE 0 END"
    for item, test in (("AWP", "part % 4 = 0"), ("AK-47", "part % 4 = 1"), ("Glock-18", "true"), ("Smoke Grenade", "part % 3 = 0"), ("C4 Explosive", "part % 6 = 0 AND steamid < 5"))
)


@query(
    "round_context",
    "P34",
    f"""WITH {TABLES}, tax AS (SELECT demo_stem, round_num, tick, steamid, floor(s.tax * 1000)::INT AS armor FROM raw),
    pl AS (SELECT tk.*, armor, 'p' || steamid AS name, CASE WHEN part % 4 = 0 THEN 'AWP' WHEN part % 4 = 1 THEN 'AK-47' ELSE 'Glock-18' END AS weapon, CASE WHEN part % 3 = 0 THEN 'Smoke Grenade' ELSE 'none' END AS util, health::INT AS hp,
      {PRICES} + CASE WHEN armor > 0 THEN {V.VEST_PRICE + V.HELMET_PRICE} ELSE 0 END AS worth FROM tk JOIN tax USING (demo_stem, round_num, tick, steamid)),
    hd AS (SELECT DISTINCT demo_stem, {MAPS}[regexp_extract(demo_stem, '\\d+')::INT % 7 + 1] AS map_name FROM rd),
    sc AS (SELECT demo_stem, round_num, freeze_end, (count(*) FILTER (winner = 't') OVER w)::BIGINT AS st, (count(*) FILTER (winner = 'ct') OVER w)::BIGINT AS sct FROM rd WINDOW w AS (PARTITION BY demo_stem ORDER BY round_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    op AS (SELECT demo_stem, round_num, coalesce(min(tick) FILTER (tick >= freeze_end), max(tick)) AS tick FROM (SELECT DISTINCT demo_stem, round_num, tick FROM tk) JOIN sc USING (demo_stem, round_num) GROUP BY 1, 2),
    ec AS (SELECT demo_stem, round_num, side, count(*) AS n, count(*) FILTER (health > 0) AS alive, sum(worth) AS worth FROM pl JOIN op USING (demo_stem, round_num, tick) GROUP BY ALL),
    lab AS (SELECT s.demo_stem, s.round_num, s.side, {ECONOMY} AS buy, coalesce(worth, 0)::BIGINT AS worth FROM (SELECT demo_stem, round_num, unnest(['t', 'ct']) AS side FROM op) s LEFT JOIN ec USING (demo_stem, round_num, side)),
    ev AS (SELECT {EP.format('l_orderkey')}, l_linenumber * 40 + l_partkey % 40 AS tick, CASE WHEN l_returnflag = 'R' THEN 'death' ELSE ['plant', 'drop', 'pickup', 'defuse'][l_suppkey % 4 + 1] END AS kind,
      CASE WHEN l_returnflag = 'R' THEN 'p' || l_suppkey % 10 || CASE WHEN l_suppkey % 10 < 5 THEN ' (T)' ELSE ' (CT)' END || ' eliminated' WHEN l_suppkey % 4 = 0 THEN 'Bomb planted' WHEN l_suppkey % 4 = 3 THEN 'Bomb defused' END AS said FROM lineitem WHERE l_returnflag IN ('R', 'A')),
    el AS (SELECT demo_stem, round_num, p.tick, string_agg(printf('  %5.1fs — %s', greatest(0, (ev.tick - freeze_end) / 64), said), chr(10) ORDER BY ev.tick, kind, said) AS happened
      FROM (SELECT DISTINCT demo_stem, round_num, tick FROM tk) p JOIN ev USING (demo_stem, round_num) JOIN sc USING (demo_stem, round_num) WHERE ev.tick <= p.tick AND said IS NOT NULL GROUP BY 1, 2, 3),
    bs AS (SELECT demo_stem, round_num, p.tick, arg_max(kind, (ev.tick, kind)) AS last FROM (SELECT DISTINCT demo_stem, round_num, tick FROM tk) p JOIN ev USING (demo_stem, round_num) WHERE ev.tick <= p.tick AND kind <> 'death' GROUP BY 1, 2, 3),
    fr AS (SELECT demo_stem, round_num, tick, count(*) FILTER (side = 't' AND hp > 0) AS at_, count(*) FILTER (side = 'ct' AND hp > 0) AS act, list({{'id': steamid, 'side': side, 'name': name, 'hp': hp, 'weapon': weapon}} ORDER BY steamid) AS everybody FROM pl GROUP BY 1, 2, 3),
    x AS (SELECT pl.*, fr.at_, fr.act, list_filter(everybody, lambda m: m.side = pl.side AND m.id <> pl.steamid AND m.hp > 0) AS up, list_filter(everybody, lambda m: m.side = pl.side AND m.id <> pl.steamid AND m.hp = 0) AS down FROM pl JOIN fr USING (demo_stem, round_num, tick))
    SELECT x.demo_stem, x.round_num::BIGINT AS round_num, x.tick::BIGINT AS tick, x.steamid, md5(
      'Round ' || x.round_num || ' | T ' || st || ' - ' || sct || ' CT | ' || map_name || chr(10) || printf('Round time: %.0fs', greatest(0, (x.tick - freeze_end) / 64)) || chr(10) || chr(10)
      || 'ECONOMY (round start):' || chr(10) || '  T-side: ' || lt.buy || ' (~$' || format('{{:,}}', lt.worth) || ')' || chr(10) || '  CT-side: ' || lc.buy || ' (~$' || format('{{:,}}', lc.worth) || ')' || chr(10) || chr(10)
      || coalesce('ROUND EVENTS:' || chr(10) || happened || chr(10) || chr(10), '') || 'CURRENT STATE:' || chr(10) || '  Alive: ' || at_ || 'T vs ' || act || 'CT' || chr(10)
      || '  Bomb: ' || CASE last WHEN 'plant' THEN 'planted' WHEN 'defuse' THEN 'defused' WHEN 'drop' THEN 'dropped' ELSE 'carried' END || chr(10)
      || '  POV: ' || name || ' (' || upper(x.side) || '), ' || hp || 'hp/' || armor || 'armor, ' || weapon || ', utility: ' || util
      || CASE WHEN len(up) > 0 THEN chr(10) || '  Teammates alive: ' || array_to_string(list_transform(up, lambda m: m.name || ' (' || m.hp || 'hp, ' || m.weapon || ')'), ', ') ELSE '' END
      || CASE WHEN len(down) > 0 THEN chr(10) || '  Teammates dead: ' || array_to_string(list_transform(down, lambda m: m.name), ', ') ELSE '' END) AS digest
    FROM x JOIN sc USING (demo_stem, round_num) JOIN hd USING (demo_stem) JOIN lab lt ON lt.demo_stem = x.demo_stem AND lt.round_num = x.round_num AND lt.side = 't' JOIN lab lc ON lc.demo_stem = x.demo_stem AND lc.round_num = x.round_num AND lc.side = 'ct'
      LEFT JOIN el ON el.demo_stem = x.demo_stem AND el.round_num = x.round_num AND el.tick = x.tick LEFT JOIN bs ON bs.demo_stem = x.demo_stem AND bs.round_num = x.round_num AND bs.tick = x.tick""",
)
def round_context(t: Tables):
    """The context text of every player in every tick."""
    kept, parts = kept_ticks(t)
    players = kept.withColumn("name", F.concat(F.lit("p"), F.col("steamid").cast("string")))
    out = context.round_context(players, events_of(t), rounds(t), header(t), store_name("round_events"), path=scratch(t.spark, "round-events"), parts=parts)
    return out.select("demo_stem", F.col("round_num").cast("long").alias("round_num"), F.col("tick").cast("long").alias("tick"), "steamid", F.md5("context").alias("digest"))
