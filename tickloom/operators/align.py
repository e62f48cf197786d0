"""As-of, nearest and window joins between a frame table and an event table.

An as-of join is one ordered pass over the union of both tables: frames carry no
event, so the running maximum (minimum) of the event struct is the last (next) event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import framed, rmax, rmin, running

PART_ROWS = 1_000_000  # rows that a task sorts, twice where it looks both ways


def _asof(
    frames: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    order: str,
    payload: Sequence[str],
    back: str | None,
    ahead: str | None,
    strict: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Last (``back``) and next (``ahead``) event struct per frame, in one ordered pass.

    Frames sit at side 1, events at side 0 on the way to later ticks and at side 2 on the way back, so
    that both ways see an event at the frame's own tick and an event is one row; ``strict`` swaps the sides.
    """
    event = F.struct(F.col(order).alias("at"), *[F.col(c) for c in payload])
    first, last = (2, 0) if strict else (0, 2)
    marked = events.select(*keys, order, event.alias("__event"), F.lit(first).alias("__side"), F.lit(last).alias("__side_back"))
    rows = frames.withColumns({"__side": F.lit(1), "__side_back": F.lit(1)}).unionByName(marked, allowMissingColumns=True)
    seen = running(
        rows,
        keys,
        order,
        {back: rmax(F.col("__event"))} if back else None,
        {ahead: rmin(F.col("__event"))} if ahead else None,
        tie=["__side"],
        tie_ahead=["__side_back"],
        limit=limit,
        part_rows=PART_ROWS,
    )
    return seen.filter("__side = 1").drop("__side", "__side_back", "__event")


def last_event(
    frames: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    order: str,
    payload: Sequence[str] = (),
    *,
    name: str = "last",
    strict: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Backward as-of: adds struct ``name(at, payload…)`` of the latest event at or before a frame.

    ``strict`` looks only before the frame. Null when there is none. Events that share
    a tick resolve to the one with the largest payload.
    """
    return _asof(frames, events, keys, order, payload, name, None, strict, limit)


def next_event(
    frames: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    order: str,
    payload: Sequence[str] = (),
    *,
    name: str = "next",
    strict: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Forward as-of: the first event at or after a frame; ties resolve to the smallest payload."""
    return _asof(frames, events, keys, order, payload, None, name, strict, limit)


def since_last(frames: DataFrame, events: DataFrame, keys: Sequence[str], order: str, cap: int, name: str = "since") -> DataFrame:
    """Distance to the latest event at or before the frame, capped; the cap when none."""
    out = last_event(frames, events, keys, order, name="__last")
    gap = F.coalesce(F.least(F.col(order) - F.col("__last.at"), F.lit(cap)), F.lit(cap))
    return out.withColumn(name, gap.cast("long")).drop("__last")


def label_next(
    frames: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    order: str,
    code: str,
    horizon: int,
    none_code: int,
    label: str = "label",
    distance: str = "time_to",
) -> DataFrame:
    """Next-event label within an inclusive horizon; ``none_code`` and the horizon otherwise.

    Events at the same tick resolve to the smallest code.
    """
    out = next_event(frames, events, keys, order, [code], name="__next")
    gap = F.col("__next.at") - F.col(order)
    hit = gap <= horizon
    return out.withColumns(
        {
            label: F.when(hit, F.col(f"__next.{code}")).otherwise(F.lit(none_code)).cast("long"),
            distance: F.when(hit, gap).otherwise(F.lit(horizon)).cast("long"),
        }
    ).drop("__next")


def pick_nearest(now: Column, back: str, ahead: str, tie: str = "earlier", max_distance: int | None = None) -> Column:
    """The nearer of two event structs; equal distances go to the ``earlier`` or ``later`` one."""
    if tie not in ("earlier", "later"):
        raise ValueError("tie must be 'earlier' or 'later'")
    before, after = now - F.col(f"{back}.at"), F.col(f"{ahead}.at") - now
    use_back = F.col(ahead).isNull() | (before <= after if tie == "earlier" else before < after)
    chosen = F.when(F.col(back).isNotNull() & use_back, F.col(back)).otherwise(F.col(ahead))
    return chosen if max_distance is None else F.when(F.least(before, after) <= max_distance, chosen)


def nearest_event(
    frames: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    order: str,
    payload: Sequence[str] = (),
    *,
    tie: str = "earlier",
    max_distance: int | None = None,
    name: str = "nearest",
) -> DataFrame:
    """Nearest event on either side, as a struct."""
    both = bracketing_events(frames, events, keys, order, payload)
    return both.withColumn(name, pick_nearest(F.col(order), "back", "ahead", tie, max_distance)).drop("back", "ahead")


def bracketing_events(frames: DataFrame, events: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str] = ()) -> DataFrame:
    """Adds the last and the next event as ``back`` and ``ahead``."""
    return _asof(frames, events, keys, order, payload, "back", "ahead")


def lookup_or_zero(frames: DataFrame, cache: DataFrame, keys: Sequence[str], order: str, vector: str, size: int, tie: str = "earlier") -> DataFrame:
    """Vector of the nearest cached row plus a found flag; zeros when the key is unknown."""
    out = nearest_event(frames, cache, keys, order, [vector], tie=tie, name="__hit")
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    return out.withColumns({"found": F.col("__hit").isNotNull(), vector: F.coalesce(F.col(f"__hit.{vector}"), zero)}).drop("__hit")


def at_horizon(frames: DataFrame, keys: Sequence[str], order: str, step: int, payload: Sequence[str], end: str | None = None, tie: str = "later") -> DataFrame:
    """Self-join with the state ``step`` later (clamped to the episode ``end``), nearest available tick."""
    target = F.col(order) + step
    if end is not None:
        target = F.least(target, F.col(end))
    goal = frames.withColumn("__now", F.col(order)).withColumn(order, target.cast(dict(frames.dtypes)[order]))
    hit = nearest_event(goal, frames, keys, order, payload, tie=tie, name="future")
    return hit.withColumn(order, F.col("__now")).drop("__now")


def window_first(
    frames: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    order: str,
    flags: dict[str, Column],
    width: int,
) -> DataFrame:
    """First event of each kind within ``[t, t + width]``: one order column per flag, null when absent."""
    tagged = events.select(*keys, order, *[F.when(cond, F.col(order)).alias(f"__k_{n}") for n, cond in flags.items()], F.lit(False).alias("__frame"))
    both = frames.withColumn("__frame", F.lit(True)).unionByName(tagged, allowMissingColumns=True)

    def firsts(w):
        ahead = w.rangeBetween(0, width)
        return {n: F.min(f"__k_{n}").over(ahead) for n in flags}

    out = framed(both, keys, order, firsts, before=0, after=width, unit="range")
    return out.filter("__frame").drop("__frame", *[f"__k_{n}" for n in flags])


def engagement(first_given: Column, first_taken: Column, now: Column, width: int) -> tuple[Column, Column]:
    """(initiated, delay in [0, 1]) from the first given and first taken event in the window."""
    initiated = F.coalesce(first_given <= first_taken, first_given.isNotNull())
    soonest = F.least(first_given, first_taken)
    delay = F.coalesce(F.least(F.greatest((soonest - now) / F.lit(width), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    return initiated, delay


def interval_labels(frames: DataFrame, events: DataFrame, keys: Sequence[str], order: str, ahead: int, clear_before: int, clear_after: int) -> DataFrame:
    """1 when an event falls in (t, t+ahead], 0 when none in [t-clear_before, t+clear_after], else null."""
    both = frames.withColumn("__hit", F.lit(0)).unionByName(
        events.select(*keys, order, F.lit(1).alias("__hit")), allowMissingColumns=True
    )
    both = both.withColumn("__frame", F.col("__hit") == 0)

    def counts(w):
        return {
            "__pos": F.sum("__hit").over(w.rangeBetween(1, ahead)),
            "__near": F.sum("__hit").over(w.rangeBetween(-clear_before, clear_after)),
        }

    reach = max(ahead, clear_after)
    out = framed(both, keys, order, counts, before=clear_before, after=reach, unit="range").filter("__frame")
    label = F.when(F.coalesce(F.col("__pos"), F.lit(0)) > 0, 1).when(F.coalesce(F.col("__near"), F.lit(0)) == 0, 0)
    return out.withColumn("label", label.cast("long")).drop("__hit", "__frame", "__pos", "__near")


def event_triggered(frames: DataFrame, events: DataFrame, keys: Sequence[str], position: str, value: str, before: int, after: int) -> DataFrame:
    """Mean of ``value`` per offset around events (positions of ``frames`` are consecutive)."""
    around = events.select(*keys, F.col(position).alias("__event"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"))
    around = around.withColumn(position, F.col("__event") + F.col("offset"))
    hits = around.join(frames.select(*keys, position, value), [*keys, position])
    return hits.groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
