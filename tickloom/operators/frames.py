"""Recordings to frames: down-sampled player and global frames with features and labels.

Tables are keyed by ``demo_stem`` and ``round_num`` (one episode). Everything is one lazy
plan; the recording and the round are partition keys, not loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import encode, loadout
from tickloom.functions import vocab as V
from tickloom.operators import align, windows
from tickloom.operators.ordered import beside, bounded_groups, join_on, meeting, near, parts_for, per_key

EPISODE = ["demo_stem", "round_num"]
SIDES = ["t", "ct"]


def frame_grid(ticks: DataFrame, step: int = 8) -> DataFrame:
    """``tick`` and ``frame`` of the kept ticks of each episode."""
    return windows.keep_every(ticks.select(*EPISODE, "tick").distinct(), EPISODE, "tick", step)


def player_frames(ticks: DataFrame, grid: DataFrame, per_side: int = 5, fill: str = "empty") -> DataFrame:
    """One row per frame and slot with scaled features and loadout.

    A slot without a row at the tick has ``is_present = false``. With ``fill="empty"`` its
    features are zero; ``"nulls"`` encodes the missing row like one full of nulls, which
    makes both cosines 1.
    """
    slots = windows.assign_slots(ticks, EPISODE, "tick", "steamid", "side", SIDES, per_side)
    slots = slots.groupBy(*EPISODE).agg(F.collect_list(F.struct("slot", "steamid")).alias("__slots"))
    row = F.struct("steamid", *[c for c in ticks.columns if c not in (*EPISODE, "tick", "side", "steamid")], F.lit(True).alias("is_present"))
    frame = ticks.groupBy(*EPISODE, "tick").agg(F.collect_list(row).alias("__rows"))  # a tick has a handful of players
    cells = beside(beside(grid, [frame], [*EPISODE, "tick"]), [slots], EPISODE)

    numbers = F.sequence(F.lit(0).cast("long"), F.lit(2 * per_side - 1).cast("long"))
    none = F.lit(None).cast(frame.schema["__rows"].dataType.elementType)

    def cell(slot, held):
        return F.struct(slot.alias("slot"), held.alias("row"))

    def slotted(held):
        """The row once for every slot of its player."""
        return F.transform(F.filter("__slots", lambda s: s["steamid"].eqNullSafe(held["steamid"])), lambda s: cell(s["slot"], held))

    cells = cells.withColumn("__held", F.flatten(F.transform("__rows", slotted)))
    free = F.transform(F.array_except(numbers, F.coalesce("__held.slot", F.array().cast("array<long>"))), lambda slot: cell(slot, none))
    cells = cells.withColumn("__cell", F.explode(F.concat(F.coalesce("__held", F.slice(free, 1, 0)), free)))
    full = cells.select(*EPISODE, "frame", "tick", "__cell.slot", "__cell.row.*")
    present = F.coalesce("is_present", F.lit(False))
    features = encode.player_features()
    held = loadout.loadout(F.col("inventory"))
    if fill == "empty":
        features = {n: F.when(present, e).otherwise(0.0) for n, e in features.items()}
    return full.select(*EPISODE, "frame", "tick", "slot", "steamid", present.alias("is_present"), *[e.alias(n) for n, e in {**features, **held}.items()])


def team_totals(ticks: DataFrame) -> DataFrame:
    """Money, equipment and living players per tick and side; missing values count as zero."""

    def side_sum(side, value):
        return F.sum(F.when(F.col("side") == side, F.coalesce(value, F.lit(0))).otherwise(0))

    aggs = []
    for s in SIDES:
        aggs += [
            side_sum(s, F.col("balance")).alias(f"{s}_money"),
            side_sum(s, F.col("current_equip_value")).alias(f"{s}_equip"),
            F.count_if((F.col("side") == s) & (F.col("health") > 0)).alias(f"{s}_alive"),
        ]
    return ticks.groupBy(*EPISODE, "tick").agg(*aggs)


def first_plants(bomb: DataFrame, header: DataFrame) -> DataFrame:
    """First plant of each episode with the site derived from its position."""
    place = F.struct(F.col("tick"), F.coalesce("X", F.lit(0.0)).alias("x"), F.coalesce("Y", F.lit(0.0)).alias("y"), F.col("Z").alias("z"), F.col("bombsite"))
    first = bomb.filter("event = 'plant'").groupBy(*EPISODE).agg(F.min(place).alias("p"))
    flat = first.select(*EPISODE, F.col("p.x").alias("plant_x"), F.col("p.y").alias("plant_y"), F.col("p.z").alias("plant_z"), F.col("p.bombsite").alias("plant_label"))
    named = flat.join(header, "demo_stem", "left")
    site = encode.nearest_site(*[F.col(c) for c in ("map_name", "plant_x", "plant_y", "plant_z", "plant_label")])
    return named.withColumn("site", site).drop("map_name")


def label_events(kills: DataFrame, bomb: DataFrame, rounds: DataFrame) -> DataFrame:
    """Labelled events with their vocabulary code.

    Kills need an attacker side. Bomb events match by part of their name. An explosion known
    only from the round's reason falls on its end; both sources together count once.
    """
    code = {e: F.lit(i) for i, e in enumerate(V.EVENTS)}
    side, name = F.lower("attacker_side"), F.lower("event")
    k = kills.select(*EPISODE, "tick", F.when(side == "t", code["kill_t"]).when(side == "ct", code["kill_ct"]).alias("code"))
    b = bomb.select(
        *EPISODE, "tick",
        F.when(name.contains("plant"), code["bomb_planted"]).when(name.contains("defus"), code["bomb_defused"])
        .when(name.contains("explod") | name.contains("detonat"), code["bomb_exploded"]).alias("code"),
    )
    end = rounds.select(*EPISODE, F.coalesce("end", "official_end").alias("tick"), F.lower("reason").contains("explod").alias("boom")).filter("tick IS NOT NULL")
    e = end.select(*EPISODE, "tick", F.explode(F.array_compact(F.array(F.when(F.col("boom"), code["bomb_exploded"]), code["round_end"]))).alias("code"))
    return k.unionByName(b).unionByName(e).filter("code IS NOT NULL").distinct()


def tempo_events(kills: DataFrame, bomb: DataFrame, rounds: DataFrame) -> DataFrame:
    """Ticks of any kill, exact plants and defusals, and explosions, for the time-since features."""
    end = rounds.filter(F.lower("reason").contains("explod")).select(*EPISODE, F.coalesce("end", "official_end").alias("tick"))
    exact = bomb.filter(F.lower("event").isin("plant", "defuse")).select(*EPISODE, "tick")
    return kills.select(*EPISODE, "tick").unionByName(exact).unionByName(end).filter("tick IS NOT NULL").distinct()


def global_frames(ticks: DataFrame, players: DataFrame, kills: DataFrame, bomb: DataFrame, rounds: DataFrame, header: DataFrame, grid: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per frame: phase, clocks, bomb, score, team differences, tempo and the next-event label.

    Tables dealt by episode in so many ``parts`` are not shuffled again.
    """
    last = grid.groupBy(*EPISODE).agg(F.max("tick").alias("__last"))
    played = join_on(rounds.withColumn("winner", F.coalesce("winner", F.lit(""))), last, EPISODE, "inner")  # empty rounds do not score
    scored = windows.scores_before(played, ["demo_stem"], "round_num", "winner", SIDES)
    info = scored.select(*EPISODE, "freeze_end", F.coalesce("end", "official_end", "__last").alias("end"), "bomb_plant", "score_t", "score_ct")
    info = join_on(info.join(header, "demo_stem", "left"), first_plants(bomb, header), EPISODE, "left")

    rows = meeting(grid, near(info, EPISODE, parts), EPISODE)
    carried = players.groupBy(*EPISODE, "tick").agg(F.max("has_c4").alias("__c4"))
    rows = beside(rows, [carried, team_totals(ticks)], [*EPISODE, "tick"])
    rows = align.since_last(rows, kills.select(*EPISODE, "tick").distinct(), EPISODE, "tick", V.EVENT_HORIZON, "since_kill")
    rows = align.since_last(rows, tempo_events(kills, bomb, rounds), EPISODE, "tick", V.EVENT_HORIZON, "since_event")
    rows = align.label_next(rows, label_events(kills, bomb, rounds), EPISODE, "tick", "code", V.EVENT_HORIZON, V.EVENTS.index("none"), "event_label", "event_time")

    tick, plant = F.col("tick"), F.col("bomb_plant")
    down = (F.coalesce(plant, F.lit(0)) > 0) & F.col("plant_x").isNotNull() & (tick >= plant)
    seconds = encode.round_clock(tick, F.col("freeze_end"))

    def gap(what, scale):
        return (F.coalesce(f"t_{what}", F.lit(0)) - F.coalesce(f"ct_{what}", F.lit(0))) / scale

    columns = {
        "phase": encode.phase(tick, F.col("freeze_end"), plant, F.col("end")),
        "bomb_state": encode.bomb_state(F.coalesce("__c4", F.lit(0.0)) > 0.5, down, F.col("site")),
        "bomb_x": F.when(down, F.col("plant_x") / 3000).otherwise(0.0),
        "bomb_y": F.when(down, F.col("plant_y") / 3000).otherwise(0.0),
        "bomb_age": F.when(down, (tick - plant) / float(V.TICK_RATE) / V.FUSE_S).otherwise(0.0),
        "round_time": seconds / 115,
        "score_t_n": F.col("score_t") / 16,
        "score_ct_n": F.col("score_ct") / 16,
        "round_n": F.col("round_num") / 30,
        "money_diff": gap("money", 5e4),
        "equip_diff": gap("equip", 5e4),
        "alive_t": F.coalesce("t_alive", F.lit(0)) / 5,
        "alive_ct": F.coalesce("ct_alive", F.lit(0)) / 5,
        "alive_diff": gap("alive", 5.0),
        "since_kill_n": F.col("since_kill") / V.EVENT_HORIZON,
        "since_event_n": F.col("since_event") / V.EVENT_HORIZON,
        **encode.sinusoids(seconds),
    }
    keep = [*EPISODE, "frame", "tick", "map_name", "score_t", "score_ct", "since_kill", "since_event", "event_label", "event_time"]
    return rows.select(*keep, *[e.alias(n) for n, e in columns.items()])


def build(ticks: DataFrame, kills: DataFrame, bomb: DataFrame, rounds: DataFrame, header: DataFrame, step: int = 8, parts: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(player frames, global frames, grid). Group sizes are checked once, on the inputs.

    Tables are dealt by episode once; ``ticks`` may lie so already, in as many buckets as ``parts`` says.
    """
    inputs = [(df, EPISODE) for df in (ticks, kills, bomb, rounds)]
    with bounded_groups([*inputs, (rounds, ["demo_stem"])]) as n:
        if parts is None:
            parts = parts_for(ticks.sparkSession, n)
            ticks = near(ticks, EPISODE, parts)
        kills, bomb, rounds = (near(df, EPISODE, parts) for df in (kills, bomb, rounds))
        grid = frame_grid(ticks, step)
        players = player_frames(ticks, grid)
        return players, global_frames(ticks, players, kills, bomb, rounds, header, grid, parts), grid


def episodes(grid: DataFrame, rounds: DataFrame, header: DataFrame, step: int = 8) -> DataFrame:
    """Episode metadata: frames, first and last tick, winner, reason and map."""
    g = grid.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("n_ticks"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))
    full = join_on(g, rounds.select(*EPISODE, "winner", "reason"), EPISODE, "left").join(header, "demo_stem", "left")
    return full.withColumn("downsample", F.lit(step))


def player_array(columns: Sequence[str] = encode.PLAYER_SCALARS) -> F.Column:
    """The fixed-width player vector: scalars, bomb flag, both category one-hots, utility bits."""

    def hot(name):
        return encode.one_hot_of(V.CATEGORIES, F.col(name))

    scalars = F.array(*[F.col(c).cast("float") for c in (*columns, "has_c4")])
    bits = F.array(*[F.col(f"util_{u}").cast("float") for u in V.UTILITY_BITS])
    return F.concat(scalars, hot("primary"), hot("secondary"), bits)


def global_array() -> F.Column:
    """The fixed-width global vector, in the order of the layout."""
    names = ["score_t_n", "score_ct_n", "round_n", "round_time"]
    tail = ["bomb_x", "bomb_y", "bomb_age", "money_diff", "equip_diff", "alive_t", "alive_ct", "alive_diff", "since_kill_n", "since_event_n"]
    waves = [f"{f}_{p:g}s" for f in ("sin", "cos") for p in V.CLOCK_PERIODS_S]

    def floats(columns):
        return F.array(*[F.col(c).cast("float") for c in columns])

    def hot(words, column):
        return encode.one_hot_of(words, F.col(column))

    return F.concat(hot(V.MAPS, "map_name"), hot(V.PHASES, "phase"), floats(names), hot(V.BOMB_STATES, "bomb_state"), floats(tail), floats(waves))


def feature_table(players: DataFrame, frames: DataFrame, n_slots: int = 10) -> DataFrame:
    """``features array<float>`` per frame: the slots in order, then the global block."""
    cells = players.select(*EPISODE, "frame", "slot", player_array().alias("v"))
    wide = cells.groupBy(*EPISODE, "frame").agg(*[F.max(F.when(F.col("slot") == i, F.col("v"))).alias(f"__{i}") for i in range(n_slots)])
    both = meeting(wide, frames.select(*EPISODE, "frame", global_array().alias("__g")), [*EPISODE, "frame"])
    return both.select(*EPISODE, "frame", F.concat(*[F.col(f"__{i}") for i in range(n_slots)], F.col("__g")).alias("features"))


def reanchored_clock(frames: DataFrame, position: str = "frame") -> DataFrame:
    """Clock in seconds since the first live frame (the whole episode when there is none)."""
    out = per_key(frames, EPISODE, {"__live": F.min(F.when(F.col("phase") == "live", F.col(position)))})
    clock = F.greatest(F.lit(0.0), (F.col(position) - F.coalesce("__live", F.lit(0))) / float(V.FRAME_HZ))
    return out.withColumn("round_time_s", clock).drop("__live")


def drop_positions(players: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames with the last carrier position while the bomb lies dropped, and the clamped age."""
    carrier = F.min(F.when(F.col("has_c4") > 0.5, F.struct("slot", "x", "y"))).alias("__c")
    c = players.groupBy(*EPISODE, "frame").agg(carrier)
    joined = beside(frames, [c], [*EPISODE, "frame"]).withColumns(
        {"carried": F.col("__c").isNotNull(), "planted": F.col("bomb_state").startswith("planted"), "__x": F.col("__c.x"), "__y": F.col("__c.y")}
    )
    out = windows.hold_dropped(joined, EPISODE, "frame", "carried", "planted", "__x", "__y")
    loose = F.col("drop_x").isNotNull()
    age = encode.clip01(F.col("bomb_age"))
    return out.withColumns(
        {
            "bomb_x": F.when(loose, F.col("drop_x")).otherwise(F.col("bomb_x")),
            "bomb_y": F.when(loose, F.col("drop_y")).otherwise(F.col("bomb_y")),
            "age_clamped": age != F.col("bomb_age"),
            "bomb_age": age,
        }
    ).drop("__c", "__x", "__y", "drop_x", "drop_y")
