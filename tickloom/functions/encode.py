"""Numeric encodings as Catalyst expressions: player and frame features, clocks, sites, buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import vocab as V


def lookup(table: dict, key: Column, default=None) -> Column:
    """Value of a small fixed table for ``key``."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def index_of(words: Sequence[str], key: Column, missing: int = -1) -> Column:
    return lookup({w: i for i, w in enumerate(words)}, key, missing)


def one_hot(index: Column, size: int) -> Column:
    """Float array with a 1 at ``index``; all zeros outside the range."""
    return F.array(*[F.coalesce(index == i, F.lit(False)).cast("float") for i in range(size)])


def one_hot_of(words: Sequence[str], key: Column) -> Column:
    """Float array with a 1 at the position of ``key`` in the vocabulary."""
    return F.array(*[F.coalesce(key == w, F.lit(False)).cast("float") for w in words])


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def non_negative(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0)).cast("double"), F.lit(0.0))


def player_features(c=F.col) -> dict[str, Column]:
    """Scaled scalar features of one player row, in layout order; nulls count as 0/false."""

    def num(name):
        return F.coalesce(c(name).cast("double"), F.lit(0.0))

    def bit(name):
        return F.coalesce(c(name), F.lit(False)).cast("double")

    yaw, pitch = F.radians(num("yaw")), F.radians(num("pitch"))
    return {
        "x": num("X") / 3000,
        "y": num("Y") / 3000,
        "z": num("Z") / 500,
        "sin_yaw": F.sin(yaw),
        "cos_yaw": F.cos(yaw),
        "sin_pitch": F.sin(pitch),
        "cos_pitch": F.cos(pitch),
        "hp": non_negative(c("health")) / 100,
        "armor": non_negative(c("armor")) / 100,
        "helmet": bit("has_helmet"),
        "defuser": bit("has_defuser"),
        "log_balance": F.log1p(non_negative(c("balance"))) / 10,
        "log_equip": F.log1p(non_negative(c("current_equip_value"))) / 10,
        "alive": (non_negative(c("health")) > 0).cast("double"),
    }


PLAYER_SCALARS = [
    "x", "y", "z", "sin_yaw", "cos_yaw", "sin_pitch", "cos_pitch", "hp", "armor", "helmet", "defuser", "log_balance", "log_equip", "alive",
]
UNITS = {"x": 3000.0, "y": 3000.0, "z": 500.0, "hp": 100.0, "armor": 100.0, "score_t": 16.0, "score_ct": 16.0, "round_num": 30.0, "round_time": 115.0, "bomb_x": 3000.0, "bomb_y": 3000.0, "bomb_age": 40.0, "money_diff": 5e4, "equip_diff": 5e4, "alive_t": 5.0, "alive_ct": 5.0, "alive_diff": 5.0}
LOGGED = ["log_balance", "log_equip"]


def denormalise(name: str, value: Column) -> Column:
    """Inverse of the feature scaling, in game units."""
    if name in LOGGED:
        return F.expm1(value * 10)
    return value * UNITS.get(name, 1.0)


def hot_name(vector: Column, names: Sequence[str]) -> Column:
    """Name of the largest entry of a one-hot vector; null when it is all zero."""
    at = F.array_position(vector, F.array_max(vector))
    return F.when(F.array_max(vector) > 0, F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int")))


# Column groups that an ablation zeroes; layout is by name, so no offsets are needed.
BOOKKEEPING = ["score_t", "score_ct", "round_num", "round_time"]
PHASE_COLUMNS = [f"phase_{p}" for p in V.PHASES]
BOMB_COLUMNS = [f"bomb_{b}" for b in V.BOMB_STATES] + ["bomb_x", "bomb_y", "bomb_age"]
SPATIAL = ["x", "y", "z"]
LOADOUT_COLUMNS = ["has_c4", "primary", "secondary", *[f"util_{u}" for u in V.UTILITY_BITS]]
PLAYER_COLUMNS = [*PLAYER_SCALARS, *LOADOUT_COLUMNS]
ABLATIONS = {
    "baseline": [],
    "no_score": ["score_t", "score_ct"],
    "no_round_num": ["round_num"],
    "no_round_time": ["round_time"],
    "no_bookkeeping": BOOKKEEPING,
    "no_bomb": BOMB_COLUMNS,
    "no_alive": ["alive"],
    "no_hp_armor": ["hp", "armor"],
    "no_alive_hp_armor": ["alive", "hp", "armor"],
    "no_phase": PHASE_COLUMNS,
    "spatial_only": [c for c in PLAYER_COLUMNS if c not in SPATIAL] + PHASE_COLUMNS + BOOKKEEPING + BOMB_COLUMNS,
    "bookkeeping_only": PLAYER_COLUMNS,
}


def ablate(df, columns: Sequence[str]):
    """Zeroes the named feature columns that are present."""
    present = set(df.columns)
    return df.withColumns({c: F.lit(0.0) for c in columns if c in present})


def phase(tick: Column, freeze_end: Column, plant: Column, end: Column) -> Column:
    """Round phase; a later stage overrides an earlier one."""
    return (
        F.when(tick >= end, "end")
        .when(F.coalesce(plant, F.lit(0)) > 0, F.when(tick >= plant, "post_plant").when(tick < freeze_end, "freeze").otherwise("live"))
        .when(tick < freeze_end, "freeze")
        .otherwise("live")
    )


def nearest_site(map_name: Column, x: Column, y: Column, z: Column, label: Column) -> Column:
    """'a' or 'b': height split on the stacked map, else the nearer centroid (ties a), else the label."""

    def squared(i):
        cx = lookup({m: c[i] for m, c in V.SITE_CENTROIDS.items()}, map_name)
        cy = lookup({m: c[i + 1] for m, c in V.SITE_CENTROIDS.items()}, map_name)
        return (x - cx) ** 2 + (y - cy) ** 2

    by_label = F.when(F.lower(F.trim(label)).endswith("b"), "b").otherwise("a")
    by_centroid = F.when(squared(0) <= squared(2), "a").otherwise("b")
    known = map_name.isin(*V.SITE_CENTROIDS)
    by_height = F.when(z >= V.STACKED_SPLIT_Z, "a").otherwise("b")
    return F.when((map_name == V.STACKED_MAP) & z.isNotNull(), by_height).when(known, by_centroid).otherwise(by_label)


def bomb_state(carried: Column, planted: Column, site: Column) -> Column:
    return F.when(planted, F.concat(F.lit("planted_"), site)).when(carried, "carried").otherwise("none")


def round_clock(tick: Column, freeze_end: Column) -> Column:
    """Seconds of play since the freeze ended, never negative."""
    return F.greatest(F.lit(0.0), (tick - freeze_end) / float(V.TICK_RATE))


def sinusoids(seconds: Column) -> dict[str, Column]:
    angles = {p: F.lit(2 * math.pi) * seconds / p for p in V.CLOCK_PERIODS_S}
    return {f"sin_{p:g}s": F.sin(a) for p, a in angles.items()} | {f"cos_{p:g}s": F.cos(a) for p, a in angles.items()}


def gated_distance(planted: Column, dx: Column, dy: Column) -> Column:
    """Distance to the bomb as a share of 3000 units, 1.0 while nothing is planted."""
    return F.when(planted, F.least(F.hypot(dx, dy), F.lit(V.FAR)) / V.FAR).otherwise(F.lit(1.0))


def ring_index(magnitude: Column) -> Column:
    """How many ring edges (after the first) lie strictly below the magnitude: edges close on the right."""
    return sum(((magnitude > e).cast("long") for e in V.RING_EDGES[1:]), F.lit(0).cast("long"))


def displacement_class(dx: Column, dy: Column) -> Column:
    """0 when still, else 1 + ring * 16 + direction (half-even rounding to 16 bearings)."""
    size = F.hypot(dx, dy)
    bearing = F.rint(F.atan2(dy, dx) / (2 * math.pi / V.RING_DIRECTIONS)).cast("long")
    cls = 1 + ring_index(size) * V.RING_DIRECTIONS + F.pmod(bearing, F.lit(V.RING_DIRECTIONS))
    return F.when(size < V.RING_EDGES[0], 0).otherwise(cls).cast("long")


def class_centre(cls: Column) -> tuple[Column, Column]:
    """Magnitude and bearing (radians, null when still) of a displacement class."""
    mids = [math.sqrt(a * b) for a, b in zip(V.RING_EDGES, V.RING_EDGES[1:])] + [V.OPEN_RING_MAGNITUDE]
    ring = F.floor((cls - 1) / V.RING_DIRECTIONS)
    size = F.when(cls == 0, 0.0).otherwise(F.element_at(F.array(*[F.lit(m) for m in mids]), (ring + 1).cast("int")))
    return size, F.when(cls > 0, F.pmod(cls - 1, F.lit(V.RING_DIRECTIONS)) * (2 * math.pi / V.RING_DIRECTIONS))


def angle_between(ax: Column, ay: Column, bx: Column, by: Column, eps: float = 1e-9) -> Column:
    """Angle in degrees between two planar vectors; a zero vector gives 90."""
    cos = (ax * bx + ay * by) / (F.sqrt(ax**2 + ay**2) * F.sqrt(bx**2 + by**2) + eps)
    return F.degrees(F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))))


def turn_bucket(speed: Column, size: Column, angle: Column, degenerate: bool = False) -> Column:
    """0 still, 1 straight … 4 reversal; edges close on the right. ``degenerate`` adds -1 for no past motion."""
    bucket = sum(((angle > e).cast("long") for e in V.TURN_EDGES), F.lit(1).cast("long"))
    bucket = F.when((speed < V.STILL_SPEED) & (size < V.STILL_DISPLACEMENT), 0).otherwise(bucket)
    return F.when((speed == 0) & (bucket > 0), -1).otherwise(bucket) if degenerate else bucket


def money_bucket(money: Column) -> Column:
    return F.when(money < 2000, "eco").when(money < 3500, "force-buy").when(money < 4500, "half-buy").otherwise("full-buy")


def health_bucket(hp: Column) -> Column:
    return F.when(hp >= 90, ">=90").when(hp >= 80, "80-89").when(hp >= 60, "60-79").when(hp >= 40, "40-59").otherwise("<40")


def weapon_bucket(weapon: Column) -> Column:
    return (
        F.when(weapon.isNull() | (weapon == ""), "pistol_only")
        .when(weapon.isin(*V.SNIPERS), "sniper")
        .when(weapon.isin(*V.RIFLES), "rifle")
        .when(weapon.isin(*V.SMGS), "smg")
        .when(weapon.isin(*V.HEAVIES), "heavy")
        .otherwise("other")
    )


def round_importance(score_t: Column, score_ct: Column, round_num: Column) -> Column:
    gap = F.abs(score_t - score_ct)
    ahead = F.when(score_t > score_ct, "T-side").otherwise("CT-side")
    behind = F.when(score_t < score_ct, "T-side").otherwise("CT-side")
    return (
        F.when(score_t + score_ct + 1 >= 24, "critical — overtime round")
        .when(round_num <= 5, "early — economy establishment phase")
        .when(gap >= 5, F.format_string("moderate — %s has significant lead (%d rounds ahead)", ahead, gap))
        .when(gap == 0, "high — score is tied")
        .otherwise(F.format_string("elevated — %s trails by %d", behind, gap))
    )


def clock_text(tick: Column, anchor: Column) -> Column:
    """Elapsed time as M:SS."""
    s = F.floor(F.greatest(F.lit(0.0), (tick - anchor) / float(V.TICK_RATE)))
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def fuse_text(tick: Column, plant: Column) -> Column:
    """Remaining fuse as 0:SS, null outside the 40 s after the plant."""
    gone = (tick - plant) / float(V.TICK_RATE)
    ticking = (F.coalesce(plant, F.lit(0)) > 0) & (gone >= 0) & (gone <= V.FUSE_S)
    return F.when(ticking, F.format_string("0:%02d", F.floor(V.FUSE_S - gone)))


def raster(x: Column, y: Column, origin_x: Column, origin_y: Column, scale: Column) -> tuple[Column, Column]:
    """World to raster pixel, truncated toward zero."""
    return ((x - origin_x) / scale).cast("long"), ((origin_y - y) / scale).cast("long")


def state_vector(c=F.col) -> list[Column]:
    """19 numbers describing a player's situation."""
    mates, foes = c("alive_teammates"), c("alive_enemies")

    def flag(cond):
        return F.when(cond, 1.0).otherwise(0.0)

    bomb = F.lower(c("bomb_status"))
    return [
        flag(F.upper(c("player_side")) == "CT"),
        flag(F.lower(c("round_phase")) == "post-plant"),
        *[flag(F.lower(c("map_name")) == m) for m in V.STATE_MAPS],
        (mates - foes) / 5.0,
        flag(F.coalesce(c("weapon_primary"), F.lit("")) != ""),
        c("player_health") / 100.0,
        c("player_armor") / 100.0,
        F.least(F.coalesce(F.size("utility"), F.lit(0)), F.lit(4)) / 4.0,
        F.when(bomb == "planted", 0.5).when(bomb == "dropped", 1.0).otherwise(0.0),
        F.least(mates, F.lit(4)) / 4.0,
        F.least(foes, F.lit(5)) / 5.0,
        F.least(c("visible_enemies"), F.lit(5)) / 5.0,
    ]


def action_vector(move: Column, objective: Column, utility_count: Column, initiated: Column, delay: Column) -> list[Column]:
    return [
        F.coalesce(move, F.lit(0)).cast("double"),
        F.coalesce(objective, F.lit(0)).cast("double"),
        F.least(F.coalesce(utility_count, F.lit(0)), F.lit(4)) / 4.0,
        F.coalesce(initiated, F.lit(False)).cast("double"),
        F.coalesce(delay, F.lit(1.0)).cast("double"),
    ]


def structured_vector(c=F.col) -> list[Column]:
    """11 plain numbers of a state for a structured classifier."""
    mates, foes = c("alive_teammates").cast("double"), c("alive_enemies").cast("double")
    return [
        mates,
        foes,
        mates - foes,
        mates / F.greatest(foes, F.lit(1.0)),
        *[F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in ("player_health", "player_armor", "player_money", "visible_enemies")],
        F.when(c("player_side") == "T", 1.0).otherwise(0.0),
        lookup(V.PHASE_CODES, F.lower(c("round_phase")), 2).cast("double"),
        lookup(V.BOMB_CODES, F.lower(c("bomb_status")), 0).cast("double"),
    ]


def approach(before: Column, after: Column, threshold: float = V.MOVE_THRESHOLD) -> Column:
    """1 when a distance shrank by more than the threshold, -1 when it grew, else 0."""
    gain = before - after
    return F.when(gain > threshold, 1).when(gain < -threshold, -1).otherwise(0)
