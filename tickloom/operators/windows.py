"""Per-episode window operators: down-sampling, slots, scores, hold/reset, segments, crops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import beside, framed, hash_order, join_on, per_key, ranked, rcount, rmax, rsum, running


def keep_every(rows: DataFrame, episode: Sequence[str], order: str, step: int) -> DataFrame:
    """Every ``step``-th tick that is present in the episode, with its ``frame`` number.

    Counts present ticks, so a gap shortens the grid; all rows of a kept tick stay.
    """
    ticks = rows.select(*episode, order).distinct()
    grid = ranked(ticks, episode, order, "__pos").filter((F.col("__pos") - 1) % step == 0)
    grid = grid.withColumn("frame", F.floor((F.col("__pos") - 1) / step).cast("long")).drop("__pos")
    return beside(rows, [grid], [*episode, order]).filter("frame IS NOT NULL")


def keep_on_grid(rows: DataFrame, episode: Sequence[str], order: str, step: int) -> DataFrame:
    """Rows whose tick lies on the fixed grid from the episode's first tick."""
    timed = per_key(rows, episode, [F.min(order).alias("__first")])
    gap = F.col(order) - F.col("__first")
    return timed.filter(gap % step == 0).withColumn("frame", (gap / step).cast("long")).drop("__first")


def assign_slots(rows: DataFrame, episode: Sequence[str], order: str, entity: str, side: str, sides: Sequence[str], per_side: int = 5) -> DataFrame:
    """Entities present at the episode's first tick, by id, first ``per_side`` of each side.

    Slots are numbered side by side: ``per_side`` for the first side, then the next.
    """
    timed = per_key(rows.select(*episode, order, entity, F.lower(side).alias("side")), episode, {"__first": F.min(order)})
    at_start = timed.filter(F.col(order).eqNullSafe(F.col("__first")))
    present = at_start.filter(F.col("side").isin(*sides)).select(*episode, "side", entity).distinct()
    numbered = ranked(present, [*episode, "side"], entity, "__n").filter(F.col("__n") <= per_side)
    base = F.lit(0)
    for i, s in enumerate(sides):
        base = F.when(F.col("side") == s, i * per_side).otherwise(base)
    return numbered.select(*episode, entity, "side", (base + F.col("__n") - 1).cast("long").alias("slot"))


def prior_totals(rows: DataFrame, keys: Sequence[str], order: str, flags: dict[str, Column], tie: Sequence[str] = ()) -> DataFrame:
    """How often each flag was true strictly before the row."""
    aggs = {n: rsum(F.when(c, 1).otherwise(0)) for n, c in flags.items()}
    out = running(rows, keys, order, aggs, tie=tie, exclusive=True)
    return out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in flags})


def scores_before(rounds: DataFrame, match: Sequence[str], number: str, winner: str, sides: Sequence[str], played: Column | None = None) -> DataFrame:
    """Running score before each round. ``played`` limits which rounds count (default: all)."""
    counts = F.lit(True) if played is None else played
    return prior_totals(rounds, match, number, {f"score_{s}": counts & (F.lower(winner) == s) for s in sides})


def displacement(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], k: int, smooth: int = 4, tie: Sequence[str] = ()) -> DataFrame:
    """k-step future difference ``d_*``, one-step velocity ``v_*`` and smoothed velocity ``vs_*``."""

    def diffs(w):
        out = {}
        for c in columns:
            out[f"d_{c}"] = F.lead(c, k).over(w) - F.col(c)
            out[f"v_{c}"] = F.col(c) - F.lag(c, 1).over(w)
            out[f"vs_{c}"] = (F.col(c) - F.lag(c, smooth).over(w)) / smooth
        return out

    return framed(rows, keys, order, diffs, before=smooth, after=k, tie=tie)


def hold_until(rows: DataFrame, keys: Sequence[str], order: str, source: Column, value: Column, reset: Column, name: str, tie: Sequence[str] = ()) -> DataFrame:
    """Value of the latest ``source`` row, kept until a ``reset`` row; null outside."""
    at = F.struct(F.col(order).alias("at"), *[F.col(c) for c in tie])
    tagged = rows.withColumns(
        {"__src": F.when(source, F.struct(at.alias("pos"), value.alias("value"))), "__rst": F.when(reset, at)}
    )
    out = running(tagged, keys, order, {"__held": rmax(F.col("__src")), "__cut": rmax(F.col("__rst"))}, tie=tie)
    open_ = F.col("__held").isNotNull() & (F.col("__cut").isNull() | (F.col("__held.pos") > F.col("__cut")))
    return out.withColumn(name, F.when(open_, F.col("__held.value"))).drop("__src", "__rst", "__held", "__cut")


def hold_dropped(frames: DataFrame, episode: Sequence[str], order: str, carried: str, planted: str, x: str, y: str) -> DataFrame:
    """Last carrier position between a drop and the next pickup or plant, as ``drop_x``/``drop_y``.

    ``x``/``y`` are the first carrier's coordinates per frame (null when nobody carries).
    A drop from an unusable position opens no interval.
    """

    def prev(w):
        return {"__was": F.lag(carried).over(w), "__px": F.lag(x).over(w), "__py": F.lag(y).over(w)}

    seen = framed(frames, episode, order, prev, before=1, after=0)
    usable = F.col("__px").isNotNull() & F.col("__py").isNotNull() & ~F.isnan("__px") & ~F.isnan("__py")
    edge = F.coalesce(F.col("__was"), F.lit(False)) & ~F.col(carried) & ~F.col(planted)
    spot = F.when(usable, F.struct(F.col("__px").alias("x"), F.col("__py").alias("y")))
    held = hold_until(seen, episode, order, edge, spot, F.col(planted) | F.col(carried), "__drop")
    return held.withColumns({"drop_x": F.col("__drop.x"), "drop_y": F.col("__drop.y"), "is_drop": edge & usable}).drop(
        "__was", "__px", "__py", "__drop"
    )


def time_since(rows: DataFrame, keys: Sequence[str], position: str, flag: Column, reset: Column, cap: int, name: str) -> DataFrame:
    """Positions since ``flag`` was last true, capped; the cap after a ``reset`` until the next flag; 0 on resets."""
    tagged = rows.withColumns({"__f": F.when(flag, F.col(position)), "__r": F.when(reset, F.col(position)), "__dead": reset})
    out = running(tagged, keys, position, {"__lf": rmax(F.col("__f")), "__lr": rmax(F.col("__r"))})
    alive = F.col("__lf").isNotNull() & (F.col("__lr").isNull() | (F.col("__lf") > F.col("__lr")))
    since = F.when(F.col("__dead"), 0).when(alive, F.least(F.col(position) - F.col("__lf"), F.lit(cap))).otherwise(cap)
    return out.withColumn(name, since.cast("long")).drop("__f", "__r", "__dead", "__lf", "__lr")


def trailing_mean(rows: DataFrame, keys: Sequence[str], order: str, value: str, n: int, name: str, tie: Sequence[str] = ()) -> DataFrame:
    """Mean of the last ``n`` rows up to and including this one."""
    return framed(rows, keys, order, lambda w: {name: F.avg(value).over(w.rowsBetween(-n + 1, 0))}, before=n - 1, after=0, tie=tie)


def mean_so_far(rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str, tie: Sequence[str] = ()) -> DataFrame:
    """Mean from the start of the episode."""
    out = running(rows, keys, order, {"__s": rsum(F.col(value)), "__n": rcount(F.col(value))}, tie=tie)
    return out.withColumn(name, F.col("__s") / F.col("__n")).drop("__s", "__n")


def causal_mean(rows: DataFrame, keys: Sequence[str], order: str, value: str, width: int, name: str, size: int | None = None) -> DataFrame:
    """Mean over ``[t - width, t]``; element by element when ``size`` gives a vector length."""

    def means(w):
        past = w.rangeBetween(-width, 0)
        if size is None:
            return {name: F.avg(value).over(past)}
        return {name: F.array(*[F.avg(F.col(value)[i]).over(past) for i in range(size)])}

    return framed(rows, keys, order, means, before=width, after=0, unit="range")


def segments(rows: DataFrame, keys: Sequence[str], order: str, boundary: Column, cap: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Segment number = boundaries so far, clamped to ``cap - 1``."""
    out = running(rows.withColumn("__b", boundary), keys, order, {"segment": rsum(F.when(F.col("__b"), 1).otherwise(0))}, tie=tie)
    number = F.col("segment") if cap is None else F.least(F.col("segment"), F.lit(cap - 1))
    return out.withColumn("segment", number.cast("long")).drop("__b")


def segment_stats(rows: DataFrame, keys: Sequence[str], value: str, flags: dict[str, Column]) -> DataFrame:
    """Size, mean and within-segment variance of ``value`` and event counts per segment."""
    return rows.groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean_value"),
        F.var_pop(value).alias("within_var"),
        *[F.count_if(c).alias(n) for n, c in flags.items()],
    )


def next_segment_target(stats: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Counts of the following segment; the last one has no target and is dropped."""
    ahead = stats.select(*keys, (F.col("segment") - 1).alias("segment"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return join_on(stats, ahead, [*keys, "segment"], "inner")


def ahead_counts(rows: DataFrame, keys: Sequence[str], order: str, width: int, counts: dict[str, Column], anys: dict[str, Column], tie: Sequence[str] = ()) -> DataFrame:
    """Event counts and any-flags over the next ``width`` rows; ``valid`` when all of them exist."""

    def ahead(w):
        nxt = w.rowsBetween(1, width)
        out = {n: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(nxt), F.lit(0)).cast("long") for n, c in counts.items()}
        out |= {n: F.coalesce(F.max(F.when(c, 1).otherwise(0)).over(nxt), F.lit(0)) > 0 for n, c in anys.items()}
        return out | {"valid": F.count(F.lit(1)).over(nxt) == width}

    return framed(rows, keys, order, ahead, before=0, after=width, tie=tie)


def top_fraction(rows: DataFrame, keys: Sequence[str], score: str, density: float, tie: str) -> DataFrame:
    """The ``max(1, round(density * n))`` highest-scored rows of each episode (half to even)."""
    sized = per_key(rows, keys, [F.count(F.lit(1)).alias("__n")])
    placed = running(sized.withColumn("__neg", -F.col(score)), keys, "__neg", {"pick_rank": rcount()}, tie=[tie])
    quota = F.greatest(F.lit(1), F.rint(F.lit(density) * F.col("__n")))
    return placed.filter(F.col("pick_rank") <= quota).drop("__neg", "__n")


def step_score(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], name: str = "score", tie: Sequence[str] = ()) -> DataFrame:
    """Length of the step from the previous row, over the episode's mean step; null on the first row."""

    def step(w):
        terms = [(F.col(c) - F.lag(c).over(w)) ** 2 for c in columns]
        return {"__step": F.sqrt(sum(terms[1:], terms[0]))}

    out = framed(rows, keys, order, step, before=1, after=0, tie=tie)
    out = per_key(out, keys, [F.avg("__step").alias("__mean")])
    return out.withColumn(name, F.col("__step") / F.greatest("__mean", F.lit(1e-6))).drop("__step", "__mean")


def even_positions(lengths: DataFrame, length: str, n: int) -> DataFrame:
    """Evenly spaced positions per episode, skipping the first min(20, T/10) (all of them when short)."""
    t = F.col(length).cast("long")
    skip = F.least(F.lit(20), F.greatest(F.lit(0), F.floor(t / 10))).cast("long")
    last = t - 1
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(skip + i * ((last - skip) / F.lit(max(n - 1, 1)))).cast("long")
    )
    every = F.when(skip <= last, F.sequence(skip, last))
    return lengths.withColumn("position", F.explode(F.when(t - skip <= n, every).otherwise(spaced)))


def fraction_ends(lengths: DataFrame, length: str, fractions: Sequence[float], window: int) -> DataFrame:
    """End position ``floor(f * T)`` per fraction, where a full window fits before it."""
    listed = F.explode(F.array(*[F.lit(f) for f in fractions]))
    out = lengths.withColumn("fraction", listed)
    out = out.withColumn("end", F.floor(F.col("fraction") * F.col(length)).cast("long"))
    return out.filter(F.col("end") >= window)


def strided_anchors(frames: DataFrame, episode: Sequence[str], position: str, start: int, stride: int, per_episode: int, total: int, seed: int = 0) -> DataFrame:
    """Every ``stride``-th position from ``start``, at most ``per_episode`` each and ``total`` overall, by hash."""
    grid = frames.filter((F.col(position) >= start) & ((F.col(position) - start) % stride == 0))
    keyed = grid.withColumn("__h", hash_order(*[F.col(c) for c in episode], F.col(position), seed=seed))
    few = ranked(keyed, episode, "__h", "__n", tie=[position]).filter(F.col("__n") <= per_episode)
    return few.orderBy("__h", *episode, position).limit(total).drop("__h", "__n")


def crops(frames: DataFrame, episode: Sequence[str], position: str, value: str, length: int, shift: int, per_episode: int, seed: int = 0) -> DataFrame:
    """Aligned training crops ``x`` (t…t+L-1), ``y`` (shifted by k) and ``x_prev`` (one earlier).

    ``position`` is 0-based and gapless. Starts (>= 1) are picked by hash, ``per_episode`` each.
    """

    def gather(w):
        def cut(a):
            return F.collect_list(value).over(w.rowsBetween(a, a + length - 1))

        return {"x": cut(0), "y": cut(shift), "x_prev": cut(-1)}

    out = framed(frames, episode, position, gather, before=1, after=shift + length - 1)
    full = out.filter((F.col(position) >= 1) & (F.size("y") == length) & (F.size("x_prev") == length))
    keyed = full.withColumn("__h", hash_order(*[F.col(c) for c in episode], F.col(position), seed=seed))
    return ranked(keyed, episode, "__h", "__n", tie=[position]).filter(F.col("__n") <= per_episode).drop("__h", "__n")


def supervised(frames: DataFrame, keys: Sequence[str], position: str, alive: str, frozen: str, k: int) -> DataFrame:
    """Rows that carry loss: alive now and k rows later, and not in the freeze phase."""

    def later(w):
        return {"__later": F.lead(alive, k).over(w)}

    out = framed(frames, keys, position, later, before=0, after=k)
    mask = F.col(alive) & F.coalesce("__later", F.lit(False)) & ~F.col(frozen)
    return out.withColumn("supervised", mask).drop("__later")


def backward_steps(rows: DataFrame, keys: Sequence[str], order: str, value: str, eps: float, tie: Sequence[str] = ()) -> DataFrame:
    """Marks rows whose value is below the previous one by more than ``eps``."""

    def drop(w):
        return {"decreases": F.coalesce(F.col(value) - F.lag(value).over(w) < -eps, F.lit(False))}

    return framed(rows, keys, order, drop, before=1, after=0, tie=tie)


def crop_tail(frames: DataFrame, episode: Sequence[str], position: str, ended: Column, keep: int) -> DataFrame:
    """Keeps up to ``keep`` frames from the first ended one; episodes without an end stay whole."""
    tagged = per_key(frames.withColumn("__e", ended), episode, [F.min(F.when(F.col("__e"), F.col(position))).alias("__first")])
    return tagged.filter(F.col("__first").isNull() | (F.col(position) < F.col("__first") + keep)).drop("__e", "__first")


def integrate_and_fire(frames: DataFrame, episode: Sequence[str], position: str, score: str, theta: float) -> DataFrame:
    """Frames where the accumulated score reaches ``theta`` (the accumulator restarts at 0).

    The reset makes each step depend on the last emission, so an episode is walked in order
    by one Python worker, batch by batch, holding one number of state. Episodes are bounded
    recordings; unbounded entities belong to the streaming twin.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)

    def walk(_, batches):
        level = 0.0
        for pdf in batches:
            fire = []
            for s in pdf[score].fillna(0.0):
                level += s
                fire.append(level >= theta)
                if level >= theta:
                    level = 0.0
            yield pdf[fire]

    return walk_sorted(frames, episode, position, walk, schema)


def walk_sorted(frames: DataFrame, episode: Sequence[str], position: str, walk, schema: str) -> DataFrame:
    """Runs ``walk(key, batches)`` over the rows of each episode in order, streaming Arrow batches."""
    import itertools

    keys = list(episode)
    placed = frames.repartition(*keys).sortWithinPartitions(*keys, position)

    def by_episode(pdfs):
        def pieces():
            for pdf in pdfs:
                change = (pdf[keys] != pdf[keys].shift()).any(axis=1).cumsum()
                for _, part in pdf.groupby(change, sort=False):
                    yield tuple(part[keys].iloc[0]), part

        for key, group in itertools.groupby(pieces(), key=lambda p: p[0]):
            yield from walk(key, (part for _, part in group))

    return placed.mapInPandas(by_episode, schema)
