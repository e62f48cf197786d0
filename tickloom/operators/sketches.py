"""Quantiles of groups too large to sort: mergeable sketches, stored per day.

A KLL sketch keeps a few hundred weighted values of a group and merges with others, so a day's
rows are read once; any span of days is answered from the stored sketches. A quantile's
rank is off by at most ``rank_error`` of the group's rows, with the stated confidence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 200
# The published rank error of one quantile at 99 % confidence is 2.296 / size ** 0.9723.
FACTOR, POWER = 2.296, 0.9723


def rank_error(size: int = SIZE) -> float:
    """Share of a group's rows by which a quantile's rank may be off (99 % of all times)."""
    return FACTOR / size**POWER


def write_sketches(rows: DataFrame, path: str, keys: Sequence[str], day: str, value: str, size: int = SIZE) -> None:
    """Appends one sketch per group and day. Null values are left out; a day is written once."""
    made = rows.filter(F.col(value).isNotNull()).groupBy(*keys, day).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("rows"))
    made.write.mode("append").parquet(path)


def merged(sketches: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """One sketch per group over all its days."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"), F.sum("rows").alias("rows"))


def sketch_quantiles(sketch: Column, shares: Sequence[float]) -> Column:
    """The values at the given shares, as an array."""
    return F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(float(s))) for s in shares])


def rank_errors(rows: DataFrame, edges: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """``keys, n, error``: how far the exact ranks of ``edges`` (an array column of that name) are from the shares at most.

    A value that stands in many rows covers a range of ranks; the error is the distance to that range.
    """
    right = edges.select(*[F.col(k).alias(f"__{k}") for k in keys], "edges")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    met = rows.filter(F.col(value).isNotNull()).join(right, same)
    counts = [F.count_if(F.col(value) < F.get("edges", F.lit(i))).alias(f"below_{i}") for i in range(len(shares))]
    counts += [F.count_if(F.col(value) <= F.get("edges", F.lit(i))).alias(f"upto_{i}") for i in range(len(shares))]
    sums = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts)
    off = [F.greatest(F.col(f"below_{i}") / F.col("n") - s, F.lit(s) - F.col(f"upto_{i}") / F.col("n"), F.lit(0.0)) for i, s in enumerate(shares)]
    return sums.select(*keys, "n", F.greatest(*off).alias("error") if len(off) > 1 else off[0].alias("error"))
