"""Packing documents into fixed windows by the sum-of-squares rule.

Each partition packs its own documents online. A level array counts the partly filled windows
at every fill; a document goes to the level that leaves the sum of the squared counts least, so
no fill piles up and every gap soon finds its match. Windows leave as soon as they are full.
What is still open at the end (or beyond ``max_open``) is closed by cutting the pieces of the
emptiest windows into the gaps of the fullest. No shuffle, and the memory is the open windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import tidy
from tickloom.llm.encode import CHUNK_BYTES, WordEncoder, chunks

FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class SquaresPacker:
    """Online packing of one stream of documents; ``emit`` gets each finished window's pieces.

    A piece is ``(doc, start, ids, doc_tokens)``.
    """

    def __init__(self, capacity: int, emit, max_open: int = 1024):
        self.capacity, self.emit, self.max_open = capacity, emit, max_open
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # the level array
        self.at: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level (0: a new window) whose choice leaves the least sum of squares; of equals the fullest."""
        n, top = self.count, self.capacity - size
        levels = np.append(np.flatnonzero(n[1 : top + 1]) + 1, 0)
        leaves = np.where(levels > 0, 1 - 2 * n[levels], 0)
        reached = levels + size
        joins = np.where(reached < self.capacity, 1 + 2 * n[reached], 0)
        cost = leaves + joins
        best = levels[cost == cost.min()]
        return int(best.max())

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:  # whole windows of a long document
            self.emit([(doc, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        if start == total:
            return
        size = total - start
        level = self.level_for(size)
        window = self.at[level].pop() if level else []
        window.append((doc, start, ids[start:], total))
        if level:
            self.count[level] -= 1
            self.open -= 1
        if level + size == self.capacity:
            self.emit(window)
            return
        self.count[level + size] += 1
        self.at[level + size].append(window)
        self.open += 1
        if self.open > self.max_open:
            self.close(self.max_open // 2)

    def close(self, keep: int = 0) -> None:
        """Fills gaps with cut pieces of the emptiest windows until at most ``keep`` are open.

        With ``keep=0`` the last, partly filled window is cut into windows of powers of two,
        which need no padding.
        """
        windows = [(level, w) for level in range(1, self.capacity) for w in self.at[level]]  # emptiest first
        low, high = 0, len(windows) - 1
        stock: list[tuple] = []  # pieces of windows that were taken apart
        while high >= low and (high - low + 1 > keep or stock):
            level, window = windows[high]
            high -= 1
            while level < self.capacity and (stock or low <= high):
                if not stock:
                    stock = windows[low][1][::-1]
                    low += 1
                doc, start, ids, total = stock.pop()
                room = self.capacity - level
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    stock.append((doc, start + room, ids[room:], total))
                level += min(room, len(ids))
            if level == self.capacity:
                self.emit(window)
            else:
                stock = window[::-1]
                break
        left = windows[low : high + 1]
        self.count[:] = 0
        self.at = [[] for _ in range(self.capacity + 1)]
        self.open = len(left)
        for level, window in left:
            self.count[level] += 1
            self.at[level].append(window)
        if stock:
            self._powers(stock, keep)

    def _powers(self, stock: list[tuple], keep: int) -> None:
        rest = sum(len(p[2]) for p in stock)
        if keep and rest < self.capacity:  # stays open
            self.count[rest] += 1
            self.at[rest].append(stock[::-1])
            self.open += 1
            return
        while stock:
            room = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
            rest -= room
            window = []
            while room:
                doc, start, ids, total = stock.pop()
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    stock.append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self.emit(window)


def _packer(tokenizer: str, spaced: bool, end_id: int, capacity: int, max_open: int, with_ids: bool, chunk_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer, spaced)
        base, made, rows, digests = TaskContext.get().partitionId() << 32, 0, [], []

        def emit(window: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), total, base + made, offset))
                raw = ids.astype("<u4").tobytes()
                digests.append(raw if with_ids else zlib.crc32(raw))
                offset += len(ids)
            made += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(FIELDS)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS)]
            arrays.append(pa.array(digests, pa.binary() if with_ids else pa.int64()))
            rows.clear()
            digests.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in FIELDS] + ["ids" if with_ids else "ids_crc32"])

        packer = SquaresPacker(capacity, emit, max_open)
        for batch in batches:
            for some in chunks(batch, size=chunk_bytes):
                ids, begins = encoder.encode(some.column("text"))
                for i, doc in enumerate(some.column("doc_id").to_pylist()):
                    packer.add(doc, np.append(ids[begins[i] : begins[i + 1]], np.int32(end_id)))
                yield batch_of()
        packer.close()
        yield batch_of()

    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, spaced: bool = False, max_open: int = 1024, with_ids: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Packs ``doc_id, text`` into sequences of at most ``capacity`` ids; a row per piece.

    Columns: ``doc_id, start, length, doc_tokens, sequence_id, offset`` and the piece's ``ids``
    (little-endian unsigned 32-bit) or, without them, ``ids_crc32``. Every id lies in exactly one
    piece; a sequence is full or a power of two long, so nothing is padded. Documents longer
    than a window fill whole windows first. A task holds at most ``max_open`` partly filled windows:
    where one more would open, and at the end of a partition, windows are closed by cutting the pieces
    of the emptiest into the gaps of the fullest (half of them, and all at the end).

    A null text counts as empty and keeps its end id; null and repeated ids are packed like any
    others; other columns are not read; an empty table gives no rows. ``sequence_id`` is unique:
    the partition in the upper, a count in the lower 32 bits. ``chunk_bytes`` of text are encoded at a
    time: less takes less memory and more time, the pieces are the same.
    """
    last = "ids binary" if with_ids else "ids_crc32 long"
    schema = ", ".join(f"{n} long" for n, _ in FIELDS) + f", {last}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy("encode", _packer(tokenizer, spaced, end_id, capacity, max_open, with_ids, chunk_bytes)), schema)
