"""Sharding through fixed virtual slots and a versioned map from slots to shards.

A record's slot never changes: it is a hash of its key modulo a fixed number of slots. Only the
map says which shard holds a slot, so rebalancing edits a few rows of a small table. Sizes are
aggregated per slot before anything is decided; records themselves never meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VSLOTS = 4096


def virtual_slot(*key: Column, slots: int = VSLOTS) -> Column:
    """The fixed slot of a record."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slot: str = "vslot", size: str = "size") -> DataFrame:
    """Rows and bytes of every slot that has records (at most as many rows as there are slots)."""
    return records.groupBy(F.col(slot).alias("vslot")).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shard_of[v]`` is the shard of virtual slot ``v``."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def initial(cls, shards: int, slots: int = VSLOTS) -> SlotMap:
        return cls(1, shards, tuple(v % shards for v in range(slots)))

    def grown(self) -> SlotMap:
        """One more shard: it takes an equal share of slots, in turn from the fullest shards; nothing else moves."""
        held = [[v for v, s in enumerate(self.shard_of) if s == shard] for shard in range(self.shards)]
        of = list(self.shard_of)
        for _ in range(len(of) // (self.shards + 1)):
            donor = max(range(self.shards), key=lambda s: (len(held[s]), -s))
            of[held[donor].pop()] = self.shards
        return SlotMap(self.version + 1, self.shards + 1, tuple(of))

    def rebalanced(self, sizes: dict[int, int]) -> SlotMap:
        """Moves and swaps slots between shards until no edit makes the two touched shards more equal.

        ``sizes`` has the bytes per slot. Every edit takes the fullest shard and, of the emptiest
        ones, the first for which a move or a swap lowers the larger of both loads.
        """
        of = np.array(self.shard_of)
        size = np.array([sizes.get(v, 0) for v in range(len(of))], dtype=np.int64)
        load = np.bincount(of, weights=size, minlength=self.shards).astype(np.int64)
        while True:
            high = int(load.argmax())
            edit = None
            for low in np.argsort(load, kind="stable")[: self.shards - 1]:
                gap = load[high] - load[low]
                if gap <= 1:
                    break
                mine = np.flatnonzero((of == high) & (size > 0))
                theirs = np.append(np.flatnonzero((of == low) & (size > 0)), -1)  # -1: a plain move
                other = np.where(theirs >= 0, size[theirs], 0)
                order = np.argsort(other, kind="stable")
                theirs, other = theirs[order], other[order]
                # for each slot of the full shard the partner that brings the difference nearest to gap / 2
                want = size[mine] - gap / 2
                at = np.searchsorted(other, want)
                best = None
                for near in (np.clip(at - 1, 0, len(other) - 1), np.clip(at, 0, len(other) - 1)):
                    moved = size[mine] - other[near]
                    left = np.where((moved > 0) & (moved < gap), np.abs(gap - 2 * moved), gap)
                    k = int(left.argmin())
                    if left[k] < gap and (best is None or left[k] < best[0]):
                        best = (left[k], mine[k], theirs[near[k]], moved[k])
                if best is not None:
                    edit = (low, *best[1:])
                    break
            if edit is None:
                return SlotMap(self.version + 1, self.shards, tuple(int(s) for s in of))
            low, a, b, moved = edit
            of[a] = low
            if b >= 0:
                of[b] = high
            load[high] -= moved
            load[low] += moved

    def table(self, spark: SparkSession) -> DataFrame:
        """The version as rows ``version, vslot, shard``; append them to the stored map."""
        rows = ", ".join(f"({self.version}, {v}, {s})" for v, s in enumerate(self.shard_of))
        return spark.sql(f"SELECT * FROM VALUES {rows} AS slot_map(version, vslot, shard)")

    def shard(self, slot: Column) -> Column:
        """The shard of a slot, looked up in this version (a literal array of fixed length)."""
        return F.element_at(F.array(*[F.lit(s) for s in self.shard_of]), slot + 1)


def store_map(maps: list[SlotMap], spark: SparkSession, path: str) -> DataFrame:
    """Appends versions to the stored map and returns the whole history."""
    for m in maps:
        m.table(spark).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def place(records: DataFrame, current: DataFrame, group_rows: int = 200_000, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``shard`` and ``position``, gapless from 0 within each shard.

    ``records`` has ``vslot`` and the columns of ``order``; ``current`` is one version of the map.
    A slot that outgrows one sort is cut into as many hash groups as keep about ``group_rows``
    records in each; positions are the groups' prefix sums plus the rank within the group, so no
    task sorts a whole shard.
    """
    n_groups = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(group_rows)))
    slots = records.groupBy("vslot").agg(F.count(F.lit(1)).alias("rows")).select("vslot", n_groups.cast("int").alias("groups"))
    slots = slots.join(current.select("vslot", "shard"), "vslot")
    grouped = records.join(slots, "vslot").withColumn("sub", F.pmod(F.xxhash64(F.lit("sub"), *order), F.col("groups")).cast("int"))
    counts = grouped.groupBy("shard", "vslot", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("vslot", "sub").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("vslot", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("vslot", "sub").orderBy(*order)) - 1
    return grouped.withColumn("rank", rank).join(bases, ["vslot", "sub"]).withColumn("position", (F.col("base") + F.col("rank")).cast("long")).drop("groups", "sub", "rank", "base")


def shard_records(
    records: DataFrame, shards: int, map_path: str, key: tuple[str, ...] = ("doc_id", "text_crc32"), size: str = "size", slots: int = VSLOTS, group_rows: int = 200_000
) -> DataFrame:
    """Assigns every record to a shard with near equal bytes and numbers it within the shard.

    Version 1 of the map deals slots out in turn; the bytes of all slots are summed, and version
    2 is version 1 edited until the loads meet. Both versions are stored below ``map_path``.

    Null keys hash like any value. Rows repeated under one key stay together (they share a slot)
    and take one position each. An empty table gives an empty result and an unedited map.
    Columns named ``vslot, shard, position`` are replaced.
    """
    spark = records.sparkSession
    kept = [c for c in records.columns if c not in ("vslot", "shard", "position")]
    rows = records.select(*kept, virtual_slot(*[F.col(k) for k in key], slots=slots).alias("vslot"))
    first = SlotMap.initial(shards, slots)
    sums = {r["vslot"]: int(r["bytes"] or 0) for r in slot_bytes(rows, "vslot", size).collect()}  # at most `slots` rows
    second = first.rebalanced(sums)
    history = store_map([first, second], spark, map_path)
    return place(rows, history.filter(F.col("version") == second.version), group_rows, key)
