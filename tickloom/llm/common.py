"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import checkpoint_dir

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_C = ctypes.CDLL(None)
_held: dict[str, Callable[[], None]] = {}


def holds(owner: str, release: Callable[[], None]) -> None:
    """Names what frees the tables that ``owner`` keeps in a Python worker between tasks."""
    _held[owner] = release


def only(owner: str) -> None:
    """Frees what all others than ``owner`` keep in this Python worker: workers outlive stages."""
    for name, release in _held.items():
        if name != owner:
            release()


def trim() -> None:
    """Gives freed memory back to the system: Arrow's pool and the C heap keep it otherwise, and idle workers beside a JVM at work count."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def tidy(owner: str, work: Batches) -> Batches:
    """``work`` over Arrow batches in a task that frees what others keep before, and now and then what is free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        try:
            for n, made in enumerate(work(batches), 1):
                yield made
                if n % 8 == 0:
                    trim()
        finally:
            trim()

    return run


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))  # ``lower`` is many times faster


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda.

    An expression inside a lambda is computed again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_array(value: Column, body) -> Column:
    """``let`` for an array column: its elements are unpacked once, so that slices cost their own length only."""
    return let(F.transform(value, lambda x: x), body)


def runs(n: Column, element: str, at) -> Column:
    """``at(1), ..., at(n)`` as an array of the given element type; empty where ``n`` is not positive."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at)).otherwise(F.array().cast(f"array<{element}>"))


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared storage, deleted when the driver ends in good order."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to shared storage and read back: lineage ends here, and any executor can go."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)




def without(docs: DataFrame, gone: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by ``doc_id`` and ``text_hash``; all columns stay.

    The list is sent to the tasks while it has at most ``limit`` rows, and is joined by a shuffle beyond.
    """
    names = staged(gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash")).distinct(), "gone")
    small = names.count() <= limit
    match = F.xxhash64(docs["text"]).eqNullSafe(F.col("__gone_hash")) & docs["doc_id"].eqNullSafe(F.col("__gone_id"))
    return docs.join(F.broadcast(names) if small else names, match, "left_anti")
