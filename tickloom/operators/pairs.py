"""Pairwise features inside a frame, and pairs inside a record.

A frame has a fixed number of slots, so its players are pivoted into one row (a map-side
combined aggregate) and compared there; no pair of rows is ever joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.functions import vocab as V


def slots_to_row(players: DataFrame, frame: Sequence[str], slot: str, columns: Sequence[str], n_slots: int) -> DataFrame:
    """One row per frame with ``slots``, an array of ``n_slots`` structs (null where empty)."""
    cells = F.struct(*[F.col(c) for c in columns])
    wide = players.groupBy(*frame).agg(*[F.max(F.when(F.col(slot) == i, cells)).alias(f"__{i}") for i in range(n_slots)])
    return wide.select(*frame, F.array(*[F.col(f"__{i}") for i in range(n_slots)]).alias("slots"))


def perception(players: DataFrame, frame: Sequence[str], slot: str, per_side: int = 5, sight: str | None = None, sight_range: float = V.SIGHT_RANGE) -> DataFrame:
    """Nearest enemy and mate, visible and aimed-at counts and aim error, one row per present slot.

    Players need ``x, y, dir_x, dir_y, alive``. ``sight`` optionally names an array<boolean>
    column per player (who each other slot can be seen by); without it everybody living in range
    is visible. Dead players keep zeros.
    """
    columns = ["x", "y", "dir_x", "dir_y", "alive", *([sight] if sight else [])]
    n = 2 * per_side
    wide = slots_to_row(players, frame, slot, columns, n)
    cone = math.cos(math.radians(V.HALF_VIEW_DEG))

    def features(me, i):
        others = F.transform(F.col("slots"), lambda o, j: F.struct(o.alias("o"), j.alias("j")))
        mine = F.floor(i / per_side)

        def side(p):
            return F.floor(p["j"] / per_side)

        living = F.filter(others, lambda p: F.coalesce(p["o"]["alive"], F.lit(False)) & (p["j"] != i))

        def dist(p):
            return F.sqrt((p["o"]["x"] - me["x"]) ** 2 + (p["o"]["y"] - me["y"]) ** 2)

        def nearest(same):
            ds = F.transform(F.filter(living, lambda p: (side(p) == mine) if same else (side(p) != mine)), dist)
            return F.coalesce(F.array_min(ds), F.lit(V.FAR)) / V.FAR

        def visible(p):
            in_range = (side(p) != mine) & (dist(p) <= sight_range)
            return in_range & F.coalesce(F.get(me[sight], p["j"]), F.lit(False)) if sight else in_range

        seen = F.filter(living, visible)

        def look(p):
            d = dist(p)
            return F.when(d == 0, F.lit(1.0)).otherwise(d)

        def my_dot(p):
            return (me["dir_x"] * (p["o"]["x"] - me["x"]) + me["dir_y"] * (p["o"]["y"] - me["y"])) / look(p)

        def their_dot(p):
            return (p["o"]["dir_x"] * (me["x"] - p["o"]["x"]) + p["o"]["dir_y"] * (me["y"] - p["o"]["y"])) / look(p)

        count = F.size(seen)
        best = F.greatest(F.array_max(F.transform(seen, my_dot)), F.lit(-1.0))
        aim = F.when(count > 0, F.acos(F.least(best, F.lit(1.0))) / math.pi).otherwise(1.0)
        named = {
            "near_enemy": nearest(False),
            "near_mate": nearest(True),
            "n_visible": count / float(per_side),
            "exposed": (count > 0).cast("double"),
            "n_in_view": F.size(F.filter(seen, lambda p: my_dot(p) > cone)) / float(per_side),
            "n_aiming": F.size(F.filter(seen, lambda p: their_dot(p) > cone)) / float(per_side),
            "aim_error": aim,
        }
        return F.struct(i.alias("slot"), me.isNotNull().alias("present"), *[F.when(F.coalesce(me["alive"], F.lit(False)), e).otherwise(0.0).alias(k) for k, e in named.items()])

    rows = wide.select(*frame, F.inline(F.transform("slots", features)))
    return rows.filter("present").drop("present")


def nearest_living(players: DataFrame, frame: Sequence[str], slot: str, value: str, x: Column, y: Column) -> DataFrame:
    """``value`` of the living slot nearest to a point, ties to the lower slot; null when nobody lives."""
    d2 = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2
    key = F.struct(d2.alias("d"), F.col(slot).alias("s"), F.col(value).alias("v"))
    g = players.groupBy(*frame).agg(F.min(F.when(F.col("alive"), key)).alias("__n"))
    return g.select(*frame, F.col("__n.v").alias(value), F.col("__n.s").alias("slot"))


def cells_of(x0: Column, y0: Column, x1: Column, y1: Column, grid: float) -> Column:
    """All grid cells a segment passes, column by column, as ``struct(cx, cy)``."""
    ax, bx = F.least(x0, x1), F.greatest(x0, x1)
    slope = F.when(x1 != x0, (y1 - y0) / (x1 - x0))

    def column(cx):
        left, right = F.greatest(ax, cx * grid), F.least(bx, (cx + 1) * grid)
        ya = F.coalesce(y0 + slope * (left - x0), F.least(y0, y1))
        yb = F.coalesce(y0 + slope * (right - x0), F.greatest(y0, y1))
        lo, hi = F.floor(F.least(ya, yb) / grid - 1e-9), F.floor(F.greatest(ya, yb) / grid + 1e-9)
        return F.transform(F.sequence(lo, hi), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(F.floor(ax / grid - 1e-9), F.floor(bx / grid + 1e-9)), column))


def _side(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crosses(p: Sequence[Column], q: Sequence[Column]) -> Column:
    """Whether two segments (x0, y0, x1, y1) properly cross."""
    d1, d2 = _side(*p, q[0], q[1]), _side(*p, q[2], q[3])
    d3, d4 = _side(*q, p[0], p[1]), _side(*q, p[2], p[3])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def sight_lines(players: DataFrame, frame: Sequence[str], slot: str, occluders: DataFrame, per_side: int = 5, sight_range: float = V.SIGHT_RANGE, grid: float = 500.0) -> DataFrame:
    """Pairs of living opponents in range with no occluding segment between them: ``slot_a, slot_b``.

    ``occluders(ox0, oy0, ox1, oy1)``. Lines and occluders meet on grid cells, an equi-join; a
    frame contributes at most ``per_side``² lines.
    """
    wide = slots_to_row(players, frame, slot, ["x", "y", "alive"], 2 * per_side)
    pairs = [(i, j) for i in range(per_side) for j in range(per_side, 2 * per_side)]
    s = F.col("slots")
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("slot_a"), F.lit(j).alias("slot_b"), s[i]["x"].alias("x0"), s[i]["y"].alias("y0"), s[j]["x"].alias("x1"), s[j]["y"].alias("y1"), (s[i]["alive"] & s[j]["alive"]).alias("ok"))
            for i, j in pairs
        ]
    )
    lines = wide.select(*frame, F.inline(listed)).filter("ok").drop("ok")
    lines = lines.filter(F.sqrt((F.col("x0") - F.col("x1")) ** 2 + (F.col("y0") - F.col("y1")) ** 2) <= sight_range)
    at = lines.withColumn("cell", F.explode(cells_of(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], grid)))
    walls = occluders.select("ox0", "oy0", "ox1", "oy1").distinct()
    walls = walls.withColumn("cell", F.explode(cells_of(*[F.col(c) for c in ("ox0", "oy0", "ox1", "oy1")], grid)))
    hit = at.join(walls, "cell").filter(crosses([F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(c) for c in ("ox0", "oy0", "ox1", "oy1")]))
    key = [*frame, "slot_a", "slot_b"]
    return lines.select(*key).join(hit.select(*key).distinct(), key, "left_anti")


def record_pairs(rows: DataFrame, items: str, keep: Sequence[str]) -> DataFrame:
    """Pairs i < j of the entries of an array column, one row per pair (a record's own candidates)."""
    numbered = F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("item")))
    made = F.flatten(
        F.transform(numbered, lambda a: F.transform(F.filter(numbered, lambda b: b["i"] > a["i"]), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), a["item"].alias("a"), b["item"].alias("b"))))
    )
    return rows.select(*keep, F.inline(made))


def informative_pairs(pairs: DataFrame) -> DataFrame:
    """Candidate pairs worth labelling, with their score.

    ``a`` and ``b`` are structs ``(text, reward)``. Two failed candidates and near-identical
    ones (reward and text) are dropped.
    """
    grams = pairs.withColumns({"__ga": text.trigrams(F.col("a.text")), "__gb": text.trigrams(F.col("b.text"))})
    scored = grams.withColumn("similarity", text.jaccard(F.col("__ga"), F.col("__gb"))).drop("__ga", "__gb")
    ra, rb = F.col("a.reward"), F.col("b.reward")
    failed = F.coalesce((ra == 0) & (rb == 0), F.lit(False))
    same = (F.coalesce(F.abs(ra - rb), F.lit(1.0)) < V.SAME_REWARD) & (F.col("similarity") > V.SAME_TEXT)
    return scored.filter(~failed & ~same).withColumn("informativeness", text.informativeness(ra - rb, F.col("similarity")))
