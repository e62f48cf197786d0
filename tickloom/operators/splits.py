"""Reproducible sampling, top-k, leakage-free splits: hash order instead of a random generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import hash_order, join_on, ranked, rcount, running


def fallen(team: int = 9) -> Column:
    """Somebody was already eliminated."""
    return F.col("alive_teammates") + F.col("alive_enemies") < team


def planted() -> Column:
    return F.col("bomb_status") == "planted"


def weakened(below: int = 80) -> Column:
    return F.col("player_health") < below


def sample_by_hash(rows: DataFrame, key: Sequence[Column], n: int, seed: int = 0) -> DataFrame:
    """A seeded sample of at most ``n`` rows."""
    h = F.sha2(F.concat_ws("#", *[k.cast("string") for k in key], F.lit(str(seed))), 256)
    return rows.withColumn("__h", h).orderBy("__h").limit(n).drop("__h")


def curate(rows: DataFrame, keep: Column, key: Sequence[Column], cap: int, seed: int = 0) -> DataFrame:
    """All rows worth keeping plus a capped sample of the rest; ``reason`` tells which."""
    tagged = rows.withColumn("reason", F.when(keep, "keep").otherwise("pool"))
    return tagged.filter("reason = 'keep'").unionByName(sample_by_hash(tagged.filter("reason = 'pool'"), key, cap, seed))


def top_by_score(rows: DataFrame, score: str, tie: Column, n: int) -> DataFrame:
    """The ``n`` best rows; equal scores are ordered by the stable hash of ``tie``."""
    return rows.withColumn("__t", F.sha1(tie.cast("string"))).orderBy(F.col(score).desc(), "__t").limit(n).drop("__t")


def group_split(rows: DataFrame, group: str, fraction: float, seed: int = 0, name: str = "split") -> DataFrame:
    """Whole groups into train or val: ``floor(n * (1 - fraction))`` groups by hash order train."""
    groups = rows.select(group).distinct().withColumn("__h", hash_order(F.col(group), seed=seed))
    placed = running(groups, [], "__h", {"__r": rcount()}, {"__a": rcount()}, tie=[group])
    cut = F.floor((F.col("__r") + F.col("__a") - 1) * (1 - fraction))  # rank from both ends gives the total
    split = F.when(F.col("__r") <= cut, "train").otherwise("val")
    return join_on(rows, placed.select(group, split.alias(name)), [group], "left")


def stratified_group_split(rows: DataFrame, group: str, stratum: str, fraction: float, key_strata: Sequence[str], seed: int = 0, name: str = "split") -> DataFrame:
    """Whole groups into train or val, stratified by each group's most frequent stratum.

    A stratum with n groups gives ``round(fraction * n)`` (half to even) to val, key strata at
    least one. Frequency ties go to the alphabetically first stratum.
    """
    counts = rows.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("__c"))
    dominant = counts.groupBy(group).agg(F.min(F.struct((-F.col("__c")).alias("c"), F.col(stratum).alias("s"))).alias("__d"))
    groups = dominant.select(group, F.col("__d.s").alias("__s")).withColumn("__h", hash_order(F.col(group), seed=seed))
    sizes = groups.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))
    placed = join_on(ranked(groups, ["__s"], "__h", "__r", tie=[group]), sizes, ["__s"], "left")
    quota = F.rint(F.lit(fraction) * F.col("__n"))
    quota = F.when(F.col("__s").isin(*key_strata), F.greatest(F.lit(1.0), quota)).otherwise(quota)
    marked = placed.select(group, F.when(F.col("__r") <= quota, "val").otherwise("train").alias(name))
    return join_on(rows, marked, [group], "left")


def nested_subset(rows: DataFrame, group: str, n_groups: int, seed: int = 0) -> DataFrame:
    """Rows of the first ``n_groups`` groups in hash order; larger subsets contain smaller ones."""
    groups = rows.select(group).distinct().withColumn("__h", hash_order(F.col(group), seed=seed))
    chosen = groups.orderBy("__h", group).limit(n_groups).select(group)
    return join_on(rows, chosen, [group], "left_semi")


def round_robin(rows: DataFrame, stratum: Sequence[str], episode: Sequence[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """Diverse pick: one row per episode, strata taking turns, until ``n``."""
    keyed = rows.withColumn("__h", hash_order(F.col(key), seed=seed))
    best = keyed.groupBy(*episode).agg(F.min(F.struct("__h", key)).alias("__b"))
    single = join_on(keyed, best.select(*episode, F.col(f"__b.{key}").alias(key)), [*episode, key], "left_semi")
    placed = ranked(single, stratum, "__h", "__turn", tie=[key]).filter(F.col("__turn") <= n)
    order = hash_order(*[F.col(c) for c in stratum], seed=seed)
    return placed.withColumn("__o", order).orderBy("__turn", "__o", key).limit(n).drop("__h", "__turn", "__o")


def display_swap(rows: DataFrame, key: Column, seed: int = 0, name: str = "first_shown") -> DataFrame:
    """Which candidate is shown first, by hash parity: 'A' or 'B'."""
    return rows.withColumn(name, F.when(hash_order(key, seed=seed) % 2 == 0, "A").otherwise("B"))


def top_groups(rows: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """The ``n`` largest groups with their sizes."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *group).limit(n)
