"""Checksums of files of any size.

A file is read in byte ranges by tasks of their own, never as one value: each block has its
SHA-256, and the digests of a file's blocks in order have one again, the tree digest. Where a
manifest holds a plain SHA-256, the file streams through one task in chunks instead, because
that digest can't be made in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64 << 20  # bytes of a block of the tree digest
CHUNK = 8 << 20  # bytes a task holds


def _open(path: str) -> pa.NativeFile:
    fs, inner = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return fs.open_input_file(inner)


def _digest(path: str, start: int, size: int) -> str:
    out = hashlib.sha256()
    with _open(path) as f:
        f.seek(start)
        while size > 0:
            chunk = f.read(min(size, CHUNK))
            if not chunk:
                raise OSError(f"{path} ends early")
            out.update(chunk)
            size -= len(chunk)
    return out.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([{**row, "sha256": _digest(row["path"], row["start"], row["size"])}])


def block_digests(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """``path, bytes, block, start, size, sha256`` of every block of the files (``path, bytes``); an empty file has one empty block."""
    last = F.greatest(F.ceil(F.col("bytes") / block) - 1, F.lit(0)).cast("long")
    blocks = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    start = F.col("block") * block
    blocks = blocks.select("path", "bytes", "block", start.alias("start"), F.least(F.col("bytes") - start, F.lit(block)).cast("long").alias("size"))
    return blocks.repartition("path", "block").mapInArrow(_digests, "path string, bytes long, block long, start long, size long, sha256 string")


def tree_digests(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """``path, bytes, tree``: the SHA-256 of the hex digests of a file's blocks in order."""
    by_file = block_digests(files, block).groupBy("path").agg(F.max("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("block", "sha256"))).alias("blocks"))
    return by_file.select("path", "bytes", F.sha2(F.array_join("blocks.sha256", ""), 256).alias("tree"))


def file_digests(files: DataFrame) -> DataFrame:
    """``path, bytes, sha256``: each file streamed through a task, ``CHUNK`` bytes at a time."""
    rows = files.select("path", "bytes", F.lit(0).cast("long").alias("start"), F.col("bytes").alias("size")).repartition("path")
    return rows.mapInArrow(_digests, "path string, bytes long, start long, size long, sha256 string").select("path", "bytes", "sha256")
