"""Ordered computations that survive a hot key.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. Here one
key may hold a third of the table, so every ordered operator of the package goes
through three building blocks:

``running``    prefix (or suffix) aggregates. Keys above the row limit are cut into
               order ranges; each range is scanned on its own and receives the
               aggregate of the ranges before it (one row per range).
``framed``     bounded row or range frames (lag, lead, moving averages). Hot keys
               are cut into blocks, and only the few rows a neighbouring block can
               see are copied into it.
``quantiles``  exact order statistics from (value, count) pairs.

Each first asks whether any key is above the limit: a map-side-combined count over
the key columns (column pruning drops everything else, windows upstream included).
Usually there is none, and the plan is the ordinary one-shuffle window; otherwise the
hot keys, and only those, take the split path. A pipeline of many ordered steps over the
same groups asks once, on its inputs, with ``bounded_groups``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import group_limit

RANGES_PER_LIMIT = 4  # finer than needed, so that moderate bursts still fit a task


@dataclass(frozen=True)
class Running:
    """One prefix aggregate: how to fold rows and how to merge two partial results."""

    kind: str
    column: Column

    def fold(self) -> Column:
        return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[self.kind](self.column)

    def merge(self, partial: Column) -> Column:
        return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[self.kind](partial)

    def combine(self, local: Column, carried: Column) -> Column:
        if self.kind == "count":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        if self.kind == "sum":
            return F.when(local.isNull(), carried).when(carried.isNull(), local).otherwise(local + carried)
        return F.greatest(local, carried) if self.kind == "max" else F.least(local, carried)


def rsum(column: Column) -> Running:
    return Running("sum", column)


def rcount(column: Column | None = None) -> Running:
    return Running("count", F.lit(1) if column is None else column)


def rmax(column: Column) -> Running:
    return Running("max", column)


def rmin(column: Column) -> Running:
    return Running("min", column)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on same-named keys, treating null keys as equal, keys kept once."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _keyed(df: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, list[str]]:
    """Without keys the whole table is one group; null orders are kept apart."""
    if keys:
        return df, list(keys)
    return df.withColumn("__all", F.when(F.col(order).isNull(), 1).otherwise(0)), ["__all"]


def hot_ranges(df: DataFrame, keys: Sequence[str], order: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows: first order value and range width.

    At most ``rows / limit`` keys can qualify, so this side stays small.
    """
    rows, low, high = F.count(F.lit(1)), F.min(order), F.max(order)
    return (
        df.groupBy(*keys)
        .agg(rows.alias("__rows"), low.alias("__low"), high.alias("__high"))
        .filter(F.col("__rows") > limit)
        .select(
            *keys,
            F.col("__low").cast("double").alias("__low"),
            (
                (F.col("__high").cast("double") - F.col("__low").cast("double"))
                / F.ceil(F.col("__rows") * RANGES_PER_LIMIT / F.lit(limit))
            ).alias("__width"),
        )
    )


# The key sets whose groups are known to fit a task.
_BOUNDED: ContextVar[tuple[frozenset[str], ...]] = ContextVar("bounded", default=())


def covered(keys: Sequence[str]) -> bool:
    """Whether a check that holds looked at these keys or at coarser ones."""
    return any(known <= set(keys) for known in _BOUNDED.get())


@contextmanager
def bounded_groups(tables: Iterable[tuple[DataFrame, Sequence[str]]], limit: int | None = None):
    """Checks the input tables once and spares the steps inside their own checks.

    Holds when no group of any table exceeds its share of the limit, so that even the union
    of all tables fits one task per group. If one does, the steps check and split as usual.
    Yields how many rows there are in all; None where it has been checked before.
    """
    tables = list(tables)
    if all(covered(keys) for _, keys in tables):
        yield None
        return
    limit = limit or group_limit(tables[0][0].sparkSession)
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select("n") for df, keys in tables]
    found = reduce(DataFrame.unionByName, counts).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    known = tuple(frozenset(keys) for _, keys in tables) if (found["largest"] or 0) * len(tables) <= limit else ()
    token = _BOUNDED.set(_BOUNDED.get() + known)
    try:
        yield found["rows"] or 0
    finally:
        _BOUNDED.reset(token)


def splits_needed(spans: DataFrame) -> bool:
    keys = [c for c in spans.columns if c not in ("__low", "__width")]
    return not covered(keys) and not spans.isEmpty()


def with_span(df: DataFrame, spans: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``__hot`` and ``__span``, the order range of a hot key (0 for all others)."""
    # broadcast (few by count): a join dealt by key would leave all ranges of a hot key in its one task
    joined = join_on(df, F.broadcast(spans), keys, "left")
    offset = F.floor((F.col(order).cast("double") - F.col("__low")) / F.col("__width"))
    return (
        joined.withColumn("__hot", F.col("__low").isNotNull())
        .withColumn("__span", F.when(F.col("__width") > 0, F.coalesce(offset, F.lit(-1))).otherwise(F.lit(0)).cast("long"))
        .drop("__low", "__width")
    )


def _sort(order: str, tie: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in (order, *tie)]


def dealt(df: DataFrame, keys: Sequence[str], rows: int, part_rows: int) -> DataFrame:
    """``df`` of so many ``rows`` dealt by key to parts of about ``part_rows``; as it is where an ordinary shuffle has enough of them."""
    spark, parts = df.sparkSession, -(-rows // part_rows)
    if parts <= min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        return df
    return df.repartition(parts, *keys)


def parts_for(spark, rows: int | None, part_rows: int = 1_000_000) -> int:
    """Parts to deal so many ``rows`` to: those of a shuffle, and more where a part would be larger than ``part_rows``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // part_rows))


def near(df: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    """``df`` dealt by key where all groups are known to fit a task, else as it is.

    Tables dealt alike, in as many parts, meet in unions, and their windows and aggregates by these keys
    or finer ones (``beside``, ``meeting``, ``per_key``) shuffle nothing more.
    """
    return df.repartition(parts, *keys) if parts and covered(keys) else df


def _tagged(df: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    both = df.withColumn("__mine", F.lit(True))
    for other in others:
        both = both.unionByName(other, allowMissingColumns=True)
    return both


def beside(df: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys``, null keys equal, with tables of one row per key: one pass over the union of all.

    A join compares null keys by expressions that no table is dealt by, so it shuffles both sides each time.
    """
    if not covered(keys):
        return reduce(lambda a, b: join_on(a, b, keys, "left"), others, df)
    whole = Window.partitionBy(*keys)
    columns = [c for other in others for c in other.columns if c not in keys]
    found = _tagged(df, others).withColumns({c: F.first(c, ignorenulls=True).over(whole) for c in columns})
    return found.filter("__mine").drop("__mine")


def meeting(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``, null keys equal, with a table of few rows per key: one pass over the union of both."""
    if not covered(keys):
        return join_on(df, other, keys, "inner")
    columns = [c for c in other.columns if c not in keys]
    both = _tagged(df, [other.select(*keys, F.struct(*columns).alias("__other"))])
    listed = both.withColumn("__others", F.collect_list("__other").over(Window.partitionBy(*keys))).filter("__mine")
    return listed.withColumn("__other", F.explode("__others")).select(*df.columns, *[F.col("__other")[c].alias(c) for c in columns])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggs: dict[str, Running] | None = None,
    ahead: dict[str, Running] | None = None,
    *,
    tie: Sequence[str] = (),
    tie_ahead: Sequence[str] | None = None,
    exclusive: bool = False,
    limit: int | None = None,
    part_rows: int | None = None,
) -> DataFrame:
    """Prefix aggregates (``aggs``) and suffix aggregates (``ahead``) per key in ``order``.

    ``order`` must be numeric; rows that tie on it are ordered by ``tie``, for the suffix aggregates by
    ``tie_ahead`` where it is given. With ``part_rows``, large tables are dealt to partitions of about so
    many rows, so that a task's sort does not grow with the table.
    """
    limit = limit or group_limit(df.sparkSession)
    base, keys = _keyed(df, keys, order)
    plan = [(n, a, False) for n, a in (aggs or {}).items()] + [(n, a, True) for n, a in (ahead or {}).items()]
    end = -1 if exclusive else Window.currentRow

    def scan(part: DataFrame, group: Sequence[str], prefix: str) -> DataFrame:
        frames = {
            rev: Window.partitionBy(*group).orderBy(*_sort(order, tie if tie_ahead is None or not rev else tie_ahead, rev)).rowsBetween(Window.unboundedPreceding, end)
            for rev in (False, True)
        }
        return part.withColumns({prefix + n: a.fold().over(frames[rev]) for n, a, rev in plan})

    def finish(a: Running, value: Column) -> Column:
        return F.coalesce(value, F.lit(0)) if a.kind == "count" else value

    if part_rows and not covered(keys):
        found = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
        if (found["largest"] or 0) <= limit:
            base = dealt(base, keys, found["rows"] or 0, part_rows)
            return scan(base, keys, "").drop("__all")
    spans = hot_ranges(base, keys, order, limit)
    if not splits_needed(spans):
        return scan(base, keys, "").drop("__all")

    spanned = with_span(base, spans, keys, order)
    scanned = scan(spanned, [*keys, "__span"], "__l_")
    totals = (
        spanned.filter("__hot").groupBy(*keys, "__span").agg(*[a.fold().alias(f"__t_{n}") for n, a, _ in plan])
    )
    outside = {
        rev: Window.partitionBy(*keys)
        .orderBy(F.col("__span").desc() if rev else F.col("__span").asc())
        .rowsBetween(Window.unboundedPreceding, -1)
        for rev in (False, True)
    }
    carried = totals.select(
        *keys, "__span", *[a.merge(F.col(f"__t_{n}")).over(outside[rev]).alias(f"__c_{n}") for n, a, rev in plan]
    )
    joined = join_on(scanned, F.broadcast(carried), [*keys, "__span"], "left")  # a row per range
    out = joined.withColumns({n: finish(a, a.combine(F.col(f"__l_{n}"), F.col(f"__c_{n}"))) for n, a, _ in plan})
    extra = [f"__{p}_{n}" for n, _, _ in plan for p in ("l", "c")]
    return out.drop("__span", "__hot", "__all", *extra)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    exprs: Callable[[object], dict[str, Column]],
    *,
    before: int,
    after: int,
    unit: str = "rows",
    tie: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Window expressions that look at most ``before``/``after`` rows (or order units).

    ``exprs`` gets the ordered window of one block and returns new columns; frames
    wider than declared would read a truncated neighbourhood.
    """
    limit = max(limit or group_limit(df.sparkSession), 1)
    base, keys = _keyed(df, keys, order)
    spans = hot_ranges(base, keys, order, limit)
    if not splits_needed(spans):
        whole = Window.partitionBy(*keys).orderBy(*_sort(order, tie, False))
        return base.withColumns(exprs(whole)).drop("__all")
    spans = F.broadcast(spans)
    cold = join_on(base, spans, keys, "left_anti").withColumns({"__block": F.lit(0).cast("long"), "__own": F.lit(True)})
    hot = join_on(base, spans, keys, "inner")
    if unit == "rows":
        size = max(limit, before + after, 1)
        placed = running(hot.drop("__low", "__width"), keys, order, {"__pos": rcount()}, tie=tie, limit=limit)
        at, width = F.col("__pos") - 1, F.lit(size)
    else:
        placed = hot
        at = F.col(order)
        width = F.ceil(F.greatest(F.col("__width"), F.lit(max(before + after, 1)).cast("double")))
    first, last = F.floor((at - after) / width), F.floor((at + before) / width)
    hot = (
        placed.withColumn("__home", F.floor(at / width))
        .withColumn("__block", F.explode(F.sequence(first, last)))
        .withColumn("__own", F.col("__block") == F.col("__home"))
        .drop("__home", "__pos")
    )
    columns = [*base.columns, "__block", "__own"]
    blocks = cold.select(*columns).unionByName(hot.select(*columns))
    window = Window.partitionBy(*keys, "__block").orderBy(*_sort(order, tie, False))
    return blocks.withColumns(exprs(window)).filter("__own").drop("__block", "__own", "__all")


def per_key(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column] | dict[str, Column]) -> DataFrame:
    """Whole-group aggregates joined back to the rows.

    Replaces an unbounded window: the aggregate combines map-side, and adaptive
    execution broadcasts the result or splits the skewed side of the join. Aggregates given by
    name are a window after all where groups are known to fit a task, which reads ``df`` only once.
    """
    if isinstance(aggs, dict):
        if covered(keys):
            whole = Window.partitionBy(*keys)
            return df.withColumns({n: a.over(whole) for n, a in aggs.items()})
        aggs = [a.alias(n) for n, a in aggs.items()]
    return join_on(df, df.groupBy(*keys).agg(*aggs), keys, "left")


def ranked(df: DataFrame, keys: Sequence[str], order: str, name: str = "rank", **kw) -> DataFrame:
    """1-based position of each row within its key."""
    return running(df, keys, order, {name: rcount()}, **kw)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    method: str = "linear",
    limit: int | None = None,
) -> DataFrame:
    """Exact quantiles per key, one column per entry of ``probs``, plus ``n``.

    ``linear`` interpolates, ``lower`` takes the value at floor(q(n-1)), ``nearest``
    the one at q(n-1) rounded half to even. Works on distinct values with counts, so
    a group is never held in one task.
    """
    present = df.filter(F.col(value).isNotNull())
    with bounded_groups([(present, keys)] if keys else [(present.select(value, F.lit(False).alias("__one")), ["__one"])], limit):  # counting rows is cheaper than counting distinct values
        return counted_quantiles(value_counts(present, keys, value), keys, value, "__cnt", probs, method=method, limit=limit)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, name: str = "__cnt") -> DataFrame:
    """How often each value is in each key."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(name))


def counted_quantiles(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    count: str,
    probs: dict[str, float],
    *,
    method: str = "linear",
    limit: int | None = None,
) -> DataFrame:
    """``quantiles`` of rows that come as distinct values per key with their ``count``."""
    present = counted.filter(F.col(value).isNotNull()).withColumnRenamed(count, "__cnt")
    counted, group = (present, list(keys)) if keys else (present.withColumn("__one", F.col(value).isNull()), ["__one"])
    upto = running(counted, group, value, {"__cum": rsum(F.col("__cnt"))}, limit=limit)
    total = counted.groupBy(*group).agg(F.sum("__cnt").alias("n"))
    located = join_on(upto, total, group, "inner")

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("__cum") >= position + 1, F.col(value)))

    picks = []
    for name, q in probs.items():
        h = F.col("n").cast("double") * q - q
        if method == "linear":
            picks += [at(F.floor(h)).alias(f"__lo_{name}"), at(F.ceil(h)).alias(f"__hi_{name}")]
        else:
            picks.append(at(F.floor(h) if method == "lower" else F.rint(h)).alias(name))
    out = located.groupBy(*group, "n").agg(*picks)
    if method == "linear":
        for name, q in probs.items():
            h = F.col("n").cast("double") * q - q
            lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
            out = out.withColumn(name, lo + (hi - lo) * (h - F.floor(h)))
    return out.select(*keys, "n", *probs)


def hash_order(*parts: Column, seed: int | str = 0) -> Column:
    """A uniform, reproducible 52-bit sort key from the text of ``parts``."""
    text = F.concat_ws("#", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")
