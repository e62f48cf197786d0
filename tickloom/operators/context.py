"""The context text of a sample: score, economy, what happened so far, who stands where.

A round's events are rendered once and stored in bounded blocks; a sample finds its block and its
place in it by binary search (``blocks.BlockStore.upto``), so samples and events are never
compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import loadout
from tickloom.functions import vocab as V
from tickloom.operators import windows
from tickloom.operators.blocks import store_blocks
from tickloom.operators.ordered import beside, bounded_groups, join_on, meeting, near, parts_for, per_key
from tickloom.operators.samples import opening_snapshot, status_at

ROUND = ["demo_stem", "round_num"]

# The bomb changes that are told, and how.
BOMB_EVENTS = {"plant": "Bomb planted", "planted": "Bomb planted", "bomb_planted": "Bomb planted", "defuse": "Bomb defused", "defused": "Bomb defused", "bomb_defused": "Bomb defused"}
TICK_RATE = 64


def seconds(tick: Column, freeze_end: Column) -> Column:
    return F.greatest((tick - freeze_end) / TICK_RATE, F.lit(0.0))


def event_lines(events: DataFrame, rounds: DataFrame) -> DataFrame:
    """``demo_stem, round_num, tick, kind, line`` of deaths, plants and defuses. ``events`` has ``tick, kind, player, side``."""
    said = F.when(F.col("kind") == "death", F.concat("player", F.lit(" ("), F.upper(F.coalesce("side", F.lit(""))), F.lit(") eliminated")))
    for kind, text in BOMB_EVENTS.items():
        said = said.when(F.lower("kind") == kind, text)
    timed = meeting(events.withColumn("said", said).filter("said IS NOT NULL"), rounds.select(*ROUND, "freeze_end"), ROUND)
    # ties of a printed decimal go to the even digit
    clock = F.format_string("%5.1f", F.bround(seconds(F.col("tick"), F.col("freeze_end")), 1))
    return timed.select(*ROUND, "tick", "kind", F.concat(F.lit("  "), clock, F.lit("s — "), "said").alias("line"))


def opening_economy(players: DataFrame, rounds: DataFrame) -> DataFrame:
    """``{side}_buy, {side}_worth`` of each round from the first tick at or after the freeze's end, else the last."""
    at = opening_snapshot(players.select(*ROUND, "tick").distinct(), rounds.select(*ROUND, "freeze_end"), ROUND, "tick", "freeze_end", [])
    first = meeting(players, at.select(*ROUND, F.col("snapshot.at").alias("opening")), ROUND).filter(F.col("tick") == F.col("opening"))
    worth = loadout.equipment_value(F.col("inventory"), F.col("armor"), F.col("has_helmet"))
    alive = F.coalesce("health", F.lit(0)) > 0
    aggs = []
    for side in ("t", "ct"):
        mine = F.lower("side") == side
        aggs += [F.count_if(mine).alias(f"{side}_n"), F.count_if(mine & alive).alias(f"{side}_alive"), F.coalesce(F.sum(F.when(mine, worth)), F.lit(0)).alias(f"{side}_worth")]
    sums = first.groupBy(*ROUND).agg(*aggs)
    for side in ("t", "ct"):
        living = F.col(f"{side}_alive")
        label = loadout.team_buy(F.col(f"{side}_n"), F.col(f"{side}_worth"), F.nullif(living, F.lit(0)))
        sums = sums.withColumn(f"{side}_buy", F.when((F.col(f"{side}_n") > 0) & (living == 0), "eliminated").otherwise(label))
    return sums.select(*ROUND, "t_buy", "t_worth", "ct_buy", "ct_worth")


def current_state(players: DataFrame) -> DataFrame:
    """Every player of every tick with ``alive_t, alive_ct`` and the lists ``mates_up, mates_down`` of its side, by id."""
    kit = loadout.parsed(F.col("inventory"))
    weapon = F.coalesce(kit["weapon_primary"], kit["weapon_secondary"], F.lit("knife"))
    utility = F.when(F.size(kit["utility"]) > 0, F.array_join(kit["utility"], ", ")).otherwise("none")
    hp = F.coalesce("health", F.lit(0))
    rows = players.withColumns({"weapon": weapon, "utility": utility, "hp": hp, "armour": F.coalesce("armor", F.lit(0))})
    one = F.struct("steamid", F.lower("side").alias("side"), "name", "hp", "weapon")  # a tick has a handful of players
    living = {f"alive_{s}": F.count_if((F.lower("side") == s) & (F.col("hp") > 0)) for s in ("t", "ct")}
    both = per_key(rows, [*ROUND, "tick"], {**living, "everybody": F.collect_list(one)}).withColumn("everybody", F.array_sort("everybody"))

    def mates(living: bool) -> Column:
        return F.filter("everybody", lambda m: (m["side"] == F.lower("side")) & (m["steamid"] != F.col("steamid")) & ((m["hp"] > 0) if living else (m["hp"] == 0)))

    return both.withColumns({"mates_up": mates(True), "mates_down": mates(False)}).drop("everybody")


def round_context(players: DataFrame, events: DataFrame, rounds: DataFrame, header: DataFrame, store: str, block_rows: int = 256, path: str | None = None, parts: int | None = None) -> DataFrame:
    """``context`` for every row of ``players`` (``demo_stem, round_num, tick, steamid, name, side, health, armor, has_helmet, inventory``).

    Events of one tick are ordered by kind and text. Rounds without events have no event list; the
    bomb is carried until its first change; rows of unknown rounds are left out. ``store`` names the
    stored events, which lie below ``path`` or in the warehouse. Tables are dealt by round once; ``players`` may lie so
    already, in as many buckets as ``parts`` says.
    """
    with bounded_groups([(df, ROUND) for df in (players, events, rounds)]) as n:
        if parts is None:
            parts = parts_for(players.sparkSession, n)
            players = near(players, ROUND, parts)
        return _round_context(players, near(events, ROUND, parts), near(rounds, ROUND, parts), header, store, block_rows, path, parts)


def _round_context(players: DataFrame, events: DataFrame, rounds: DataFrame, header: DataFrame, store: str, block_rows: int, path: str | None, parts: int) -> DataFrame:
    scored = windows.scores_before(rounds, ["demo_stem"], "round_num", "winner", ["t", "ct"])
    told = store_blocks(event_lines(events, rounds), store, ROUND, "tick", ["line"], block_rows, parts, tie=["kind", "line"], path=path)
    moments = players.select(*ROUND, "tick").distinct()
    changes = events.filter(F.lower("kind").isin(*V.BOMB_CHANGES)).withColumn("state", F.lower("kind"))
    changes = changes.groupBy(*ROUND, "tick").agg(F.max("state").alias("state"))  # of one tick the last by name
    moments = status_at(moments, changes, ROUND, "tick", "state", V.BOMB_CHANGES, default="carried", name="bomb")
    moments = told.upto(moments.withColumn("__id", F.struct(*ROUND, "tick")), "tick", "line", name="happened").drop("__id")
    rows = beside(current_state(players), [moments], [*ROUND, "tick"])  # every tick is a moment
    known = join_on(scored.select(*ROUND, "freeze_end", "score_t", "score_ct"), header, ["demo_stem"], "left")
    rows = meeting(meeting(rows, near(known, ROUND, parts), ROUND), opening_economy(players, rounds), ROUND)
    c, nl = F.col, F.lit("\n")

    def money(column: str) -> Column:
        return F.format_number(c(column), 0)

    up = F.array_join(F.transform("mates_up", lambda m: F.format_string("%s (%dhp, %s)", m["name"], m["hp"], m["weapon"])), ", ")
    down = F.array_join(F.transform("mates_down", lambda m: m["name"]), ", ")
    text = F.concat(
        F.format_string("Round %d | T %d - %d CT | %s\n", c("round_num"), c("score_t"), c("score_ct"), F.coalesce("map_name", F.lit("unknown"))),
        F.format_string("Round time: %.0fs\n\n", F.bround(seconds(c("tick"), c("freeze_end")), 0)),
        F.format_string("ECONOMY (round start):\n  T-side: %s (~$%s)\n  CT-side: %s (~$%s)\n\n", c("t_buy"), money("t_worth"), c("ct_buy"), money("ct_worth")),
        F.coalesce(F.concat(F.lit("ROUND EVENTS:\n"), c("happened"), F.lit("\n\n")), F.lit("")),
        F.format_string("CURRENT STATE:\n  Alive: %dT vs %dCT\n  Bomb: %s\n", c("alive_t"), c("alive_ct"), c("bomb")),
        F.format_string("  POV: %s (%s), %dhp/%darmor, %s, utility: %s", c("name"), F.upper("side"), c("hp"), c("armour"), c("weapon"), c("utility")),
        F.when(F.size("mates_up") > 0, F.concat(nl, F.lit("  Teammates alive: "), up)).otherwise(""),
        F.when(F.size("mates_down") > 0, F.concat(nl, F.lit("  Teammates dead: "), down)).otherwise(""),
    )
    return rows.select(*ROUND, "tick", "steamid", text.alias("context"))
