"""Merkle manifests of datasets by checkpoint and recompute.

A forest has one tree per group; the groups' roots are the leaves of one more tree, whose root
names the whole dataset. Every ``fan`` consecutive nodes of a level become the hash of their
digests (the last run may be shorter) until one is left. Only the leaves and every ``stride``-th level
are stored. A proof needs the levels between as well: each aligned subtree below a stored
node is hashed again from the stored descendants (``fan ** stride`` at most), gives the siblings
of every one of them, and is thrown away.

Proofs are made from the root down, one job per stored level. A subtree's way up to the root
travels once, as one row in front of the subtree's own rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.ranks import ranked

FAN, STRIDE = 8, 3
WAY = "array<struct<left:string,right:string>>"
_WAY = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def record_digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields one after another: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tree_key(group: Column) -> Column:
    """A non-null name of a group that sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(siblings, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_text(siblings: Column) -> Column:
    """All siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")


def height(size: int, fan: int) -> int:
    """Levels above the leaves of a tree with ``size`` leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size // fan), levels + 1
    return levels


def _regenerated(digests: list[str], steps: int, fan: int) -> list[list[str]]:
    """The levels of one aligned subtree from its stored descendants up."""
    levels = [digests]
    for _ in range(steps):
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + fan]).encode()).hexdigest() for i in range(0, len(below), fan)])
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one subtree at a time from batches that are sorted by ``tree, block``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch.column("tree"), batch.column("block")
        new = pc.or_(pc.not_equal(tree[1:], tree[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        cuts = [0, *(new.nonzero()[0] + 1).tolist(), batch.num_rows]
        if held and (tree[0].as_py(), block[0].as_py()) != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = (tree[-1].as_py(), block[-1].as_py())
    if held:
        yield pa.Table.from_batches(held)


def _climber(fan: int, stride: int):
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "idx", "size", "digest", "is_root"])

        for rows in _blocks(batches):
            size = rows.column("size")[0].as_py()
            steps = min(stride, height(size, fan))
            top = _regenerated(rows.column("digest").to_pylist(), steps, fan)[-1]
            out.append((rows.column("tree")[0].as_py(), rows.column("block")[0].as_py(), -(-size // fan**stride), top[0], size <= fan**stride))
            if len(out) >= 4096:
                yield made()
        yield made()

    return climb


def _prover(fan: int, stride: int, carried: list[str]):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.Table] = []
        for rows in _blocks(batches):
            upper = rows.column("way")[0].as_py()
            subroot = rows.column("subroot")[0].as_py()
            rows = rows.slice(1)
            n = rows.num_rows
            if not n:
                continue
            steps = min(stride, height(rows.column("size")[0].as_py(), fan))
            levels = _regenerated(rows.column("digest").to_pylist(), steps, fan)[:steps]
            sides = []  # of every node of the subtree: what stands left and right of it in its run
            for nodes in levels:
                runs = ["".join(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
                sides.append([(r[: 64 * (i % fan)], r[64 * (i % fan) + 64 :]) for i, r in ((i, runs[i // fan]) for i in range(len(nodes)))])
            above = [(s["left"], s["right"]) for s in upper]
            flat = [pair for i in range(n) for pair in (*(sides[k][i // fan**k] for k in range(steps)), *above)]
            left, right = (pa.array([p[k] for p in flat], pa.string()) for k in (0, 1))
            each = steps + len(above)
            ways = pa.ListArray.from_arrays(pa.array(range(0, each * n + 1, each) if each else [0] * (n + 1), pa.int32()), pa.StructArray.from_arrays([left, right], ["left", "right"]))
            table = rows.select(["tree", "idx", *carried]).append_column("siblings", ways).append_column("subroot", pa.array([subroot] * n, pa.string()))
            ready.append(table)
            if sum(x.num_rows for x in ready) >= 2048:
                yield from pa.concat_tables(ready).combine_chunks().to_batches()
                ready = []
        if ready:
            yield from pa.concat_tables(ready).combine_chunks().to_batches()

    return prove


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


@dataclass(frozen=True)
class Forest:
    """A stored manifest: leaves and every ``stride``-th level of each tree, and the tree over their roots."""

    spark: SparkSession
    path: str
    fan: int
    stride: int
    levels: int  # jobs that climbed, hence stored levels above the leaves

    def level(self, k: int) -> DataFrame:
        """Stored level ``k * stride``; above the leaves ``tree, idx, size, digest, is_root``."""
        return self.spark.read.parquet(f"{self.path}/level-{k:02d}")

    def roots(self) -> DataFrame:
        """``tree, digest``: the root of every tree."""
        tops = [self.level(k).filter("is_root").select("tree", "digest") for k in range(1, self.levels + 1)]
        out = tops[0]
        for x in tops[1:]:
            out = out.unionByName(x)
        return out

    def ways(self, upper: DataFrame) -> DataFrame:
        """Every leaf with ``siblings``, its way to the root, and ``subroot``, its tree's root.

        ``upper`` has ``tree, way, subroot`` for each tree: how it goes on above the tree's root.
        """
        block = F.floor(F.col("idx") / self.fan**self.stride).cast("long")
        from_above = None
        for k in range(self.levels - 1, -1, -1):
            nodes = self.level(k) if k == 0 else self.level(k).filter("NOT is_root").drop("is_root")
            carried = [c for c in nodes.columns if c not in ("tree", "idx", "size", "digest")] + (["digest"] if k == 0 else [])
            ends = self.level(k + 1).filter("is_root").select("tree")
            way = ends.join(upper, "tree").select("tree", F.lit(0).cast("long").alias("block"), "way", "subroot")
            if from_above is not None:
                way = way.unionByName(from_above)
            first = way.select("*", F.lit(-1).cast("long").alias("idx"))
            both = nodes.withColumn("block", block).unionByName(first, allowMissingColumns=True)
            schema = T.StructType([*(both.schema[c] for c in ("tree", "idx", *carried)), T.StructField("siblings", both.schema["way"].dataType), T.StructField("subroot", T.StringType())])
            out = _by_block(both).mapInArrow(_prover(self.fan, self.stride, carried), schema)
            from_above = out.select("tree", F.col("idx").alias("block"), F.col("siblings").alias("way"), "subroot")
        return out


def store_forest(rows: DataFrame, path: str, order: list[str], fan: int = FAN, stride: int = STRIDE) -> Forest:
    """Writes leaves and every ``stride``-th level of the trees of ``rows``.

    ``rows`` has ``tree`` (never null), ``digest`` and the columns of ``order``; all columns stay with the leaves.
    """
    spark = rows.sparkSession
    leaves = ranked(rows, "tree", [*order, "digest"], "merkle-order")
    leaves.write.parquet(f"{path}/level-00")
    level, k = spark.read.schema(leaves.schema).parquet(f"{path}/level-00"), 0
    most = level.agg(F.max("size")).first()[0] or 1
    while True:
        block = F.floor(F.col("idx") / fan**stride).cast("long").alias("block")
        up = _by_block(level.select("tree", block, "idx", "size", "digest")).mapInArrow(_climber(fan, stride), "tree string, idx long, size long, digest string, is_root boolean")
        k += 1
        up.write.parquet(f"{path}/level-{k:02d}")
        most = -(-most // fan**stride)
        level = spark.read.schema(up.schema).parquet(f"{path}/level-{k:02d}").filter("NOT is_root").drop("is_root")
        if most <= 1:
            return Forest(spark, path, fan, stride, k)


def manifest(rows: DataFrame, path: str, order: list[str], fan: int = FAN, stride: int = STRIDE) -> tuple[Forest, Forest]:
    """Stores the trees of all groups below ``path`` and the tree over their roots; see ``store_forest``."""
    trees = store_forest(rows, f"{path}/trees", order, fan, stride)
    tops = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest")
    return trees, store_forest(tops, f"{path}/top", ["member"], fan, stride)


def proofs(trees: Forest, top: Forest) -> DataFrame:
    """Every row of the manifest with ``siblings, subroot, root``.

    ``siblings`` leads from the leaf over its tree's root to the manifest's root: per level the digests
    left and right of the node in its run (both empty where the node is alone).

    Equal rows are leaves of their own with proofs of their own. Null values are values like any other
    (the caller's ``tree`` and ``digest`` are never null). A group of one row has its leaf as root. An
    empty table has no proofs and no root. Columns named ``idx, size, siblings, subroot, root`` are replaced.
    """
    spark = trees.spark
    nothing = spark.range(1).select(F.lit("").alias("tree"), F.array().cast(WAY).alias("way"), F.lit(None).cast("string").alias("subroot"))
    upper = top.ways(nothing).select(F.col("member").alias("tree"), F.col("siblings").alias("way"), F.col("digest").alias("subroot"))
    roots = top.roots().select(F.col("digest").alias("root")).take(1)  # one row
    found = trees.ways(upper)
    return found.withColumn("root", F.lit(roots[0]["root"] if roots else None).cast("string"))
