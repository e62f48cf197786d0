"""Labelled sample extraction: snapshots, states at a time, sampling grids, transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.align import last_event, nearest_event
from tickloom.operators.ordered import framed


def status_at(frames: DataFrame, changes: DataFrame, keys: Sequence[str], order: str, state: str, mapping: dict[str, str], default: str, name: str = "status") -> DataFrame:
    """Status implied by the last change at or before each frame; ``default`` before any change."""
    out = last_event(frames, changes, keys, order, [state], name="__change")
    value = F.lit(None).cast("string")
    for event, status in mapping.items():
        value = F.when(F.col(f"__change.{state}") == event, status).otherwise(value)
    return out.withColumn(name, F.coalesce(value, F.lit(default))).drop("__change")


def snapshot(frames: DataFrame, states: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str], name: str = "snapshot") -> DataFrame:
    """State at the frame: exact tick, else the latest earlier one, else the first of the episode."""
    struct = F.struct(F.col(order).alias("at"), *[F.col(c) for c in payload])
    first = states.groupBy(*keys).agg(F.min(struct).alias("__first"))
    out = last_event(frames, states, keys, order, payload, name="__upto")
    out = out.join(first, list(keys), "left")
    return out.withColumn(name, F.coalesce("__upto", "__first")).drop("__upto", "__first")


def opening_snapshot(states: DataFrame, anchors: DataFrame, keys: Sequence[str], order: str, anchor: str, payload: Sequence[str]) -> DataFrame:
    """Per episode: first state at or after ``anchor``, else the last state."""
    struct = F.struct(F.col(order).alias("at"), *[F.col(c) for c in payload])
    joined = states.join(anchors, list(keys))
    picked = joined.groupBy(*keys).agg(
        F.min(F.when(F.col(order) >= F.col(anchor), struct)).alias("__after"), F.max(struct).alias("__last")
    )
    return picked.select(*keys, F.coalesce("__after", "__last").alias("snapshot"))


def sample_every(rows: DataFrame, keys: Sequence[str], order: str, step: int, payload: Sequence[str], tie: str = "later") -> DataFrame:
    """Fixed grid from the first to the last tick of each episode, mapped to the nearest row, once each."""
    ends = rows.groupBy(*keys).agg(F.min(order).alias("__a"), F.max(order).alias("__b"))
    grid = ends.select(*keys, F.explode(F.sequence("__a", "__b", F.lit(step))).alias(order))
    hit = nearest_event(grid, rows, keys, order, payload, tie=tie, name="__hit")
    return hit.select(*keys, F.col("__hit.at").alias(order), *[F.col(f"__hit.{c}").alias(c) for c in payload]).distinct()


def previous_values(rows: DataFrame, keys: Sequence[str], order: str, value: str, n: int, name: str, tie: Sequence[str] = ()) -> DataFrame:
    """Array of the values of up to ``n`` earlier rows of the same key, oldest first."""

    def gather(w):
        return {name: F.collect_list(value).over(w.rowsBetween(-n, -1))}

    return framed(rows, keys, order, gather, before=n, after=0, tie=tie)


def falling_to_zero(rows: DataFrame, keys: Sequence[str], order: str, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Rows where ``value`` reaches zero from above (a missing value counts as zero)."""

    def prev(w):
        return {"__prev": F.lag(F.coalesce(value, F.lit(0))).over(w)}

    out = framed(rows, keys, order, prev, before=1, after=0, tie=tie)
    return out.filter((F.col("__prev") > 0) & (F.coalesce(value, F.lit(0)) == 0)).drop("__prev")


def lost_items(rows: DataFrame, keys: Sequence[str], order: str, items: str, alive: Column, watched: Column, tie: Sequence[str] = ()) -> DataFrame:
    """One row per watched item that was held at the previous tick (while alive) and is gone now."""
    tagged = rows.withColumn("__alive", alive)

    def prev(w):
        return {"__held": F.lag(items).over(w), "__was": F.lag("__alive").over(w)}

    out = framed(tagged, keys, order, prev, before=1, after=0, tie=tie)
    gone = F.array_intersect(F.array_except("__held", F.coalesce(items, F.array().cast("array<string>"))), watched)
    return out.filter("__was").withColumn("item", F.explode(gone)).drop("__alive", "__held", "__was")


def contributions(damages: DataFrame, deaths: DataFrame, actors: DataFrame, present: DataFrame, episodes: DataFrame, episode: Sequence[str]) -> DataFrame:
    """Damage, survival and objective share per (episode, player).

    ``damages(attacker, victim, amount)`` without self-hits counted, ``deaths(player, tick)``,
    ``actors(player)``, ``present(player, side, health)`` at the end of the episode and
    ``episodes(start, end, winner)`` are all keyed by ``episode``.
    """
    key = [*episode, "player"]
    hits = damages.filter(~F.col("attacker").eqNullSafe(F.col("victim")))
    dealt = hits.groupBy(*episode, F.col("attacker").alias("player")).agg(F.sum(F.coalesce("amount", F.lit(0))).alias("damage_dealt"))
    top = dealt.groupBy(*episode).agg(F.max("damage_dealt").alias("max_round_damage"))
    died = deaths.groupBy(*key).agg(F.min("tick").alias("died"))
    acted = actors.select(*key).distinct().withColumn("acted", F.lit(True))
    standing = present.filter(F.coalesce("health", F.lit(0)) > 0).join(episodes.select(*episode, "winner"), list(episode))
    last = (
        standing.filter(F.lower("side") == F.col("winner"))
        .groupBy(*episode)
        .agg(F.count(F.lit(1)).alias("n"), F.min("player").alias("player"))
        .filter("n = 1")
        .select(*key, F.lit(True).alias("last_alive"))
    )
    names = (
        hits.select(*episode, F.explode(F.array("attacker", "victim")).alias("player"))
        .unionByName(deaths.select(*key))
        .unionByName(present.select(*key))
        .filter(F.col("player").isNotNull())
        .distinct()
    )
    full = names.join(episodes, list(episode)).join(top, list(episode), "left")
    for side in (dealt, died, acted, last):
        full = full.join(side, key, "left")
    duration = F.greatest(F.lit(1), F.col("end") - F.col("start"))
    return full.select(
        *key,
        F.coalesce("damage_dealt", F.lit(0)).cast("double").alias("damage_dealt"),
        F.coalesce("max_round_damage", F.lit(1)).cast("double").alias("max_round_damage"),
        F.when(F.col("died").isNotNull(), F.greatest(F.lit(0), F.col("died") - F.col("start"))).otherwise(duration).cast("double").alias("survival_time"),
        duration.cast("double").alias("round_duration"),
        (F.coalesce("acted", F.lit(False)) | F.coalesce("last_alive", F.lit(False))).alias("objective_action"),
    )
