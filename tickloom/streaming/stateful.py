"""Structured Streaming twins of the causal operators.

Rows may come in any order within the watermark's delay: each key keeps its rows by hours of
event time until the watermark has passed them, and only then carries its small state over
them in order, in frames of whole hours with about ``FRAME_ROWS`` rows. A worker holds no more of
a key at once than such a frame, or one hour's rows where these are more. Nothing is decided before, so any cut of the input into micro-batches gives the batch
answer. Rows later than the watermark are the only ones left out; Spark counts them and
``drain`` returns the count. A key without rows for ``idle`` loses its state.
"""

from __future__ import annotations

import pickle
import sys
from heapq import heappop, heappush
from itertools import groupby
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor travels to the workers by value, so they need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUCKET_MS = 3_600_000  # event time that is never cut
FRAME_ROWS = 10_000  # whole buckets are put together up to so many rows
SMALL_ROWS = 256  # rows of a key that come together are kept together up to so many, cut between buckets
WHOLE = ("bigint", "int", "smallint", "tinyint")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class OrderedState(StatefulProcessor):
    """Feeds a key's rows in order to ``advance(state, rows) -> (state, values)``, a vector step over a pandas frame."""

    def __init__(self, columns: Sequence[tuple[str, str]], time: str, order: Sequence[str], state: Sequence[tuple[str, str]], advance: Callable, output: str, idle_ms: int | None):
        self.columns, self.time, self.order, self.fields, self.advance, self.output, self.idle = list(columns), time, list(order), list(state), advance, output, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", ", ".join(f"{n} {t}" for n, t in [("last_ms", "bigint"), *self.fields]))
        self.waiting = handle.getMapState("waiting", "low bigint, chunk bigint", "rows binary")  # entries of their own, unlike a list's
        self.chunks = handle.getValueState("chunks", "n bigint")

    def keep(self, rows: list[tuple], chunk: int) -> int:
        """Puts rows into entries of whole buckets, numbered from ``chunk``, under the first bucket they hold; returns the next number."""
        parts = []
        for _, some in groupby(sorted(rows, key=lambda r: r[0]), lambda r: r[0] // BUCKET_MS):  # a call per entry costs more than its rows
            some = list(some)
            if parts and len(parts[-1]) + len(some) <= SMALL_ROWS:
                parts[-1] += some
            else:
                parts.append(some)
        for part in parts:
            self.waiting.updateValue((part[0][0] // BUCKET_MS, chunk), (pickle.dumps(part),))
            chunk += 1
        return chunk

    def tuples(self, batch: pd.DataFrame) -> list[tuple]:
        """A batch's rows as plain values, the time in milliseconds first."""
        columns = [(batch[self.time].to_numpy().astype("datetime64[us]").astype("int64") // 1000).tolist()]
        for name, kind in self.columns:
            values, gone = batch[name].tolist(), pd.isna(batch[name].to_numpy())
            if gone.any():  # a null has turned whole numbers into floats
                columns.append([None if g else int(v) if kind in WHOLE else v for v, g in zip(values, gone)])
            else:
                columns.append([int(v) for v in values] if kind in WHOLE and batch[name].dtype.kind != "i" else values)
        return [*zip(*columns)]

    def step(self, held: tuple | None, due: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        frame = pd.DataFrame(due, columns=["__ms", *(n for n, _ in self.columns)]).sort_values(self.order, kind="stable").reset_index(drop=True)
        state, values = self.advance(tuple(held[1:]) if held else (None,) * len(self.fields), frame)
        held = (int(frame.pop("__ms").max()), *state)
        frame[self.output] = values
        return held, frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, known = None, self.chunks.get()
        chunk = known[0] if known else 0
        for batch in rows:  # one Arrow batch at a time
            if kept := self.tuples(batch):
                chunk = self.keep(kept, chunk)
                soonest = min(r[0] for r in kept)
                first = soonest if first is None else min(first, soonest)
        if first is not None:
            self.chunks.update((chunk,))
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        chunks = sorted(tuple(k) for k in self.waiting.keys())
        held = self.state.get()
        if not chunks:
            if self.idle is not None and held is not None and held[0] + self.idle <= mark:
                self.state.clear()
                self.chunks.clear()
            return
        at, opened, buckets, due, later = 0, {}, [], [], []  # ``buckets`` is a heap of those that are opened
        while at < len(chunks) or buckets:
            bucket = min([*buckets[:1], *(low for low, _ in chunks[at : at + 1])])
            if bucket * BUCKET_MS > mark:
                break
            while at < len(chunks) and chunks[at][0] <= bucket:
                for row in pickle.loads(self.waiting.getValue(chunks[at])[0]):
                    if (of := row[0] // BUCKET_MS) not in opened:
                        opened[of] = []
                        heappush(buckets, of)
                    opened[of].append(row)
                self.waiting.removeKey(chunks[at])
                at += 1
            if buckets[:1] == [bucket]:
                heappop(buckets)
            for row in opened.pop(bucket, ()):
                (due if row[0] <= mark else later).append(row)
            if len(due) >= FRAME_ROWS:
                held, frame = self.step(held, due)
                due = []
                yield frame
        if due:
            held, frame = self.step(held, due)
            yield frame
        later += [row for rows in opened.values() for row in rows]
        if later:
            self.chunks.update((self.keep(later, self.chunks.get()[0]),))
        if held is not None:
            self.state.update(held)
        wake = [*(r[0] for r in later), *(low * BUCKET_MS for low, _ in chunks[at : at + 1])]
        if wake:
            self.handle.registerTimer(min(wake))
        elif self.idle is not None and held is not None:
            self.handle.registerTimer(held[0] + self.idle)

    def close(self) -> None:
        pass


def run_ordered(
    stream: DataFrame, key: str, time: str, delay: str, order: Sequence[str], state: Sequence[tuple[str, str]], advance: Callable, output: tuple[str, str], idle_ms: int | None = None
) -> DataFrame:
    """Adds column ``output`` (name, type) computed by ``advance`` over each key's rows in order; the time column goes."""
    fields = [f for f in stream.schema.fields if f.name != time]
    schema = T.StructType(fields + T._parse_datatype_string(f"{output[0]} {output[1]}").fields)
    processor = OrderedState([(f.name, f.dataType.simpleString()) for f in fields], time, order, state, advance, output[0], idle_ms)
    marked = stream.withWatermark(time, delay)
    return marked.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


def since_last(stream: DataFrame, key: str, time: str, delay: str, order: Sequence[str], flag: str, cap: int, name: str = "since") -> DataFrame:
    """Distance to the last flagged row, capped."""
    position = order[0]

    def advance(state, rows):
        at = rows[position].where(rows[flag].astype(bool)).astype("Int64").ffill()
        if state[0] is not None:
            at = at.fillna(int(state[0]))
        gap = (rows[position].astype("Int64") - at).clip(upper=cap).fillna(cap)
        last = at.iloc[-1]
        return (None if pd.isna(last) else int(last),), gap.astype("int64")

    return run_ordered(stream, key, time, delay, order, [("at", "bigint")], advance, (name, "bigint"))


def hold_until(stream: DataFrame, key: str, time: str, delay: str, order: Sequence[str], source: str, reset: str, value: str, name: str = "held") -> DataFrame:
    """Value of the last source row until a reset row."""

    def advance(state, rows):
        resets, sources = rows[reset].astype(bool), rows[source].astype(bool)
        change = pd.Series(np.arange(len(rows)), index=rows.index).where(resets | sources).ffill()  # the row that decided last
        values = rows[value].astype(float).where(sources & ~resets)
        held = values.reindex(change).to_numpy()
        before = np.nan if state[0] is None else float(state[0])
        held = np.where(change.isna(), before, held)
        return (None if np.isnan(held[-1]) else float(held[-1]),), pd.Series(held, dtype=object).where(~np.isnan(held), None)

    return run_ordered(stream, key, time, delay, order, [("held", "double")], advance, (name, "double"))


def integrate_and_fire(stream: DataFrame, key: str, time: str, delay: str, order: Sequence[str], score: str, theta: float, name: str = "fires") -> DataFrame:
    """True where the accumulated score reaches ``theta``; the accumulator then restarts."""

    def advance(state, rows):
        level, fires = state[0] or 0.0, []
        for x in rows[score].astype(float).fillna(0.0).to_numpy():  # each step needs the one before
            level += x
            fires.append(bool(level >= theta))
            level = 0.0 if fires[-1] else level
        return (float(level),), fires

    return run_ordered(stream, key, time, delay, order, [("level", "double")], advance, (name, "boolean"))


def ingest_once(stream: DataFrame, ids: Sequence[str], time: str, delay: str) -> DataFrame:
    """Appended rows with duplicates of an id (within the watermark delay) removed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(ids))


def rule_monitor(stream: DataFrame, time: str, width: str, delay: str, rules: dict[str, Column]) -> DataFrame:
    """Rows and violations of each rule per tumbling window; run it with ``drain_updates``, which keeps open windows too."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]
    g = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("rows"), *counts)
    return g.select(F.col("w.start").alias("start"), "rows", *rules)


def late_rows(query) -> int:
    """Rows that came after the watermark, over the recorded progress of a query."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def drain(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Processes everything available now into Parquet, exactly once; returns how many rows were too late."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return late_rows(query)


def drain_updates(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Processes everything available now and returns the last state of every key, closed or still open.

    Each micro-batch writes its changed keys under its own number, so that a batch tried again
    replaces itself.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])

    def store(changed: DataFrame, batch: int) -> None:
        changed.withColumn("__batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{batch:09d}")

    query = stream.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    every = stream.sparkSession.read.schema(schema).parquet(f"{path}/batch-*")
    others = [f.name for f in stream.schema.fields if f.name not in keys]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("x"))
    return last.select(*keys, "x.*")
