"""Ordered rows of each key, stored once in blocks of bounded size and found by binary search.

A store is two bucketed tables. ``<name>_blocks`` has a row per block: up to ``block_rows`` rows of
a key in ascending order. ``<name>_index`` has a row per key: where each block starts and ends, and the
rows themselves where the key has only one block. A
batch of lookups meets the index by key and then the one block it needs by (key, block);
both tables lie in their buckets already, so only the batch is shuffled. Keys that hold very
many lookups meet their index rows, few by count, in a broadcast instead of one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.ordered import covered, ranked
from tickloom.session import group_limit

STEPS = 31  # halvings that find a place in any array


def bisect(array: Column, value: Column, strict: bool = False) -> Column:
    """How many leading elements of a sorted array are ``<= value`` (``strict``: below it)."""
    start = F.struct(F.lit(0).alias("low"), F.size(array).alias("high"))

    def halve(acc, _):
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        item = F.get(array, middle)
        right = item < value if strict else item <= value
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & right, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~right, middle).otherwise(acc["high"]).alias("high"))

    # as many steps as the array's length has bits
    bits = F.length(F.bin(F.greatest(F.size(array), F.lit(1)).cast("long")))
    return F.aggregate(F.sequence(F.lit(1), F.least(bits, F.lit(STEPS))), start, halve, lambda acc: acc["low"])


@dataclass(frozen=True)
class BlockStore:
    """Stored blocks by name; see the module for the layout."""

    spark: SparkSession
    name: str
    keys: tuple[str, ...]
    order: str
    buckets: int
    single: bool = False  # no key has more than one block

    @property
    def index(self) -> DataFrame:
        """``keys, starts, ends``: first and last order value of every block."""
        return self.spark.table(f"{self.name}_index").drop("only")

    @property
    def blocks(self) -> DataFrame:
        """``keys, block, rows``: sorted structs of the order and the payload."""
        return self.spark.table(f"{self.name}_blocks")

    def drop(self) -> None:
        for part in ("index", "blocks"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")

    def _with(self, batch: DataFrame, table: DataFrame, on: Sequence[str], dealt: bool = True) -> DataFrame:
        """The batch with the table's row; the batch is dealt into the table's buckets, which keeps the table where it lies."""
        right, kinds = table, dict(table.dtypes)
        for k in on:
            right = right.withColumnRenamed(k, f"__s_{k}")
        left = batch.withColumns({f"__k_{k}": F.col(k).cast(kinds[k]) for k in on})
        if dealt:
            left = left.repartition(self.buckets, *[f"__k_{k}" for k in on])
        same = reduce(lambda a, b: a & b, [left[f"__k_{k}"] == right[f"__s_{k}"] for k in on])
        return left.join(right, same, "left").drop(*[f"__{p}_{k}" for k in on for p in "ks"])

    def indexed(self, batch: DataFrame, limit: int | None = None, table: DataFrame | None = None) -> DataFrame:
        """The batch with ``starts, ends`` of its keys (null where the key is unknown or null)."""
        limit, index = limit or group_limit(self.spark), self.index if table is None else table
        # at most rows / limit keys can have this many lookups
        hot = batch.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).drop("__n")
        if hot.isEmpty():
            return self._with(batch, index, self.keys)
        mine = self._with(hot.dropna(), index, self.keys).filter("starts IS NOT NULL")
        same = list(self.keys)
        rest = self._with(batch.join(F.broadcast(mine.select(*same)), same, "left_anti"), index, self.keys)
        return self._with(batch.join(F.broadcast(mine.select(*same)), same, "left_semi"), F.broadcast(mine), self.keys, dealt=False).unionByName(rest)

    def nearest(self, batch: DataFrame, at: str, tie: str = "earlier", name: str = "row") -> DataFrame:
        """The batch with the stored row nearest to ``at`` as a struct ``name``; null where the key is unknown.

        Rows equally near before and after: ``tie`` says which. A null ``at`` finds nothing; repeated
        lookups are found each by itself.
        """
        if tie not in ("earlier", "later"):
            raise ValueError("tie must be 'earlier' or 'later'")
        t = F.col(at)

        def ahead_wins(before: Column, after: Column) -> Column:
            return (t - before > after - t) if tie == "earlier" else (t - before >= after - t)

        found = self.indexed(batch).withColumn("__b", F.greatest(bisect(F.col("starts"), t) - 1, F.lit(0)))
        after = F.get("starts", F.col("__b") + 1)
        over = (t > F.get("ends", F.col("__b"))) & after.isNotNull() & ahead_wins(F.get("ends", F.col("__b")), after)
        known = F.col("starts").isNotNull() & t.isNotNull()
        found = found.withColumn("__block", F.when(known, F.col("__b") + F.when(over, 1).otherwise(0)).cast("long")).drop("starts", "ends", "__b")
        met = self._with(found.withColumnRenamed("__block", "block"), self.blocks.withColumnRenamed("rows", "__rows"), [*self.keys, "block"])
        met = met.withColumn("__orders", F.col(f"__rows.{self.order}")).withColumn("__i", bisect(F.col("__orders"), t, strict=True))
        back, ahead = F.get("__rows", F.col("__i") - 1), F.get("__rows", F.col("__i"))
        use_ahead = (F.col("__i") == 0) | (ahead.isNotNull() & ahead_wins(back[self.order], ahead[self.order]))
        return met.withColumn(name, F.when(use_ahead, ahead).otherwise(back)).drop("block", "__rows", "__orders", "__i")

    def lookup_batch(self, batch: DataFrame, at: str, vector: str, size: int, tie: str = "earlier") -> DataFrame:
        """The vector nearest to each lookup and whether its key is known; zeros where it isn't. Columns ``vector`` and ``found``."""
        kept = [c for c in batch.columns if c not in (vector, "found")]
        hit = self.nearest(batch.select(*kept), at, tie, "__hit")
        stored = F.col(f"__hit.{vector}")
        zero = F.array_repeat(F.lit(0.0), size).cast(dict(self.blocks.select(F.explode("rows").alias("r")).select(f"r.{vector}").dtypes)[vector])
        return hit.withColumns({vector: F.coalesce(stored, zero), "found": F.col("__hit").isNotNull()}).drop("__hit")

    def upto(self, batch: DataFrame, at: str, text: str, separator: str = "\n", name: str = "lines") -> DataFrame:
        """The batch (with a unique ``__id``) with the ``text`` of all stored rows of its key up to ``at``, joined; null without any.

        The index says how many blocks lie before; each is met by (key, block), and only the last
        is cut, by binary search. Where no key has more than one block, its rows come with the index, and no text is shuffled; a
        batch of bounded keys that lies in the store's buckets already stays there.
        """
        if self.single:
            index = self.spark.table(f"{self.name}_index").select(*self.keys, "starts", F.col("only").alias("__only"))
            kinds = dict(index.dtypes)
            if covered(self.keys) and all(dict(batch.dtypes)[k] == kinds[k] for k in self.keys):
                met = batch.join(index.withColumnsRenamed({k: f"__s_{k}" for k in self.keys}), reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__s_{k}") for k in self.keys]), "left")
            else:
                met = self.indexed(batch, table=index)
            cut = bisect(F.col(f"__only.{self.order}"), F.col(at))
            lines = F.array_join(F.slice(F.col(f"__only.{text}"), F.lit(1), cut), separator)
            return met.select(*batch.columns, F.when(cut > 0, lines).alias(name))
        found = self.indexed(batch.select("__id", *self.keys, at))
        last = bisect(F.col("starts"), F.col(at))
        reached = found.withColumn("block", F.explode(F.when(last > 0, F.sequence(F.lit(0), last - 1)))).withColumn("block", F.col("block").cast("long")).drop("starts", "ends")
        met = self._with(reached, self.blocks, [*self.keys, "block"])
        met = met.withColumn("__orders", F.col(f"rows.{self.order}"))
        part = F.array_join(F.slice(F.col(f"rows.{text}"), F.lit(1), bisect(F.col("__orders"), F.col(at))), separator)
        parts = met.select("__id", F.struct("block", part.alias("part")).alias("p")).groupBy("__id").agg(F.array_sort(F.collect_list("p")).alias("p"))
        lines = parts.select(F.col("__id").alias("__of"), F.array_join(F.col("p.part"), separator).alias(name))
        return batch.join(lines, F.col("__id") == F.col("__of"), "left").drop("__of")


def store_blocks(rows: DataFrame, name: str, keys: Sequence[str], order: str, payload: Sequence[str], block_rows: int = 256, buckets: int = 32, tie: Sequence[str] | None = (), path: str | None = None) -> BlockStore:
    """Writes the store, below ``path`` or in the warehouse, and replaces an older one of this name.

    ``buckets`` is how many tasks a lookup runs in and belongs to the store's size: about one per 128 MB.

    Rows with a null key or order are left out. With ``tie=None`` a key has one row per order value,
    the one with the least payload; else rows of one order value all stay, ordered by ``tie``.
    """
    spark, keys = rows.sparkSession, list(keys)
    store = BlockStore(spark, name, tuple(keys), order, buckets)
    rows = rows.select(*keys, order, *payload, *[c for c in tie or () if c not in payload]).dropna(subset=[*keys, order])
    if tie is None:
        rows = rows.groupBy(*keys, order).agg(F.min(F.struct(*payload)).alias("p")).select(*keys, order, "p.*")
    placed = ranked(rows, keys, order, "__place", tie=list(tie or ()))
    block = F.floor((F.col("__place") - 1) / block_rows).cast("long")
    item = F.struct("__place", order, *payload)
    grouped = placed.groupBy(*keys, block.alias("block")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    grouped = grouped.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in (order, *payload)])))
    store.drop()

    def save(table: DataFrame, part: str, by: list[str]) -> None:
        writer = table.sortWithinPartitions(*by).write.bucketBy(buckets, *by).sortBy(*by)
        (writer.option("path", f"{path}/{part}") if path else writer).saveAsTable(f"{name}_{part}")

    save(grouped.repartition(buckets, *keys, "block"), "blocks", [*keys, "block"])
    edges = F.struct("block", F.get(F.col(f"rows.{order}"), F.lit(0)).alias("start"), F.element_at(F.col(f"rows.{order}"), -1).alias("end"))
    # of a key's blocks the first alone is sent with its rows
    dealt = store.blocks.select(*keys, edges.alias("e"), F.when(F.col("block") == 0, F.col("rows")).alias("rows")).repartition(buckets, *keys)
    index = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("e"), F.first("rows", ignorenulls=True).alias("rows"))
    only = F.when(F.size("e") == 1, F.col("rows")).alias("only")
    save(index.select(*keys, F.col("e.start").alias("starts"), F.col("e.end").alias("ends"), only), "index", keys)
    return replace(store, single=spark.table(f"{name}_index").filter("only IS NULL").isEmpty())
