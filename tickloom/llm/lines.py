"""Corpus-wide line deduplication.

Every line long enough gives a record of its key's hash, its document and its position. Records
are dealt by ranges of (hash, document) and sorted within them by hash, document (largest first)
and position, so that one pass over a range meets the keeper of each hash first and streams
the rest; nothing is held but the records of the first few documents of one hash. A hash with very
many lines is spread over several ranges: what a range can't decide alone (its first hash, and a
last one with few documents) is passed on and settled from the ranges' sums, two per range at most.

The result is one compressed keep bitmap per changed document, not its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, staged
from tickloom.llm.encode import chunks

BLANK = " \t\n\x0b\x0c\r"
RECORD = "kind int, h1 long, h2 long, named int, doc_id long, text_hash long, pos int, n_docs long"
NAMES = ["kind", "h1", "h2", "named", "doc_id", "text_hash", "pos", "n_docs"]
DROP, OPEN, SUM = 0, 1, 2


def line_keys(text: Column) -> Column:
    """The keys of a text's lines in order: stripped of ASCII white space at both ends, A-Z lower-cased."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: ascii_lower(F.trim(line, F.lit(BLANK))))


def line_records(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """A row per line whose key has at least ``min_chars`` code points; keys as 128 bits of hash."""
    lines = F.filter(F.transform(line_keys(F.col(text)), lambda key, i: F.struct(i.alias("pos"), key.alias("key"))), lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit("line"), x["key"]).alias("h2")))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.explode(hashed).alias("x"))
    return rows.select("x.h1", "x.h2", F.col("id").isNotNull().cast("int").alias("named"), F.coalesce("id", F.lit(0)).alias("doc_id"), "text_hash", "x.pos")


class _Run:
    """The lines of one hash as they stream by, the largest document first."""

    def __init__(self, key: tuple[int, int], whole: bool):
        self.key, self.whole = key, whole  # whole: it begins in this range, so its first document is the keeper
        self.keeper = self.latest = None
        self.n_docs = 0
        self.held: list[np.ndarray] = []


def _decider(min_docs: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None
        first = True
        out: list[np.ndarray] = []  # rows of eight numbers

        def put(kind: int, rows: np.ndarray) -> None:
            if len(rows):
                out.append(np.column_stack([np.full(len(rows), kind), rows, np.zeros(len(rows), np.int64)]))

        def put_sum(r: _Run) -> None:
            out.append(np.array([[SUM, *r.key, *r.keeper, 0, 0, r.n_docs]], np.int64))

        def feed(r: _Run, rows: np.ndarray) -> None:
            docs = rows[:, 2:4]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (docs[1:] != docs[:-1]).any(axis=1)
            fresh[0] = r.latest is None or tuple(docs[0]) != r.latest
            r.n_docs += int(fresh.sum())
            r.keeper = r.keeper or tuple(docs[0])
            r.latest = tuple(docs[-1])
            if not r.whole:
                put(OPEN, rows)
                return
            rest = rows[(docs != np.array(r.keeper)).any(axis=1)]
            if r.n_docs >= min_docs:
                for x in (*r.held, rest):
                    put(DROP, x)
                r.held = []
            elif len(rest):
                r.held.append(rest)

        def made() -> Iterator[pa.RecordBatch]:
            if out:
                rows = np.concatenate(out)
                out.clear()
                kinds = [pa.int32() if n in ("kind", "named", "pos") else pa.int64() for n in NAMES]
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]).cast(k) for i, k in enumerate(kinds)], names=NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(n).to_numpy().astype(np.int64) for n in ("h1", "h2", "named", "doc_id", "text_hash", "pos")])
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            bounds = np.concatenate([[0], new, [len(rows)]])
            ends_alone = run is not None and tuple(rows[0, :2]) != run.key
            if ends_alone and not run.whole:
                put_sum(run)
            if run is None or ends_alone:
                run = _Run(tuple(rows[0, :2]), not first)
                first = False
            feed(run, rows[: bounds[1]])
            if len(bounds) > 2:
                if not run.whole:
                    put_sum(run)
                # runs that begin and end in this batch are decided together
                inner = rows[bounds[1] : bounds[-2]]
                if len(inner):
                    starts = bounds[1:-2] - bounds[1]
                    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(inner))))
                    fresh = np.ones(len(inner), bool)
                    fresh[1:] = (inner[1:, :4] != inner[:-1, :4]).any(axis=1)
                    n_docs = np.bincount(of, weights=fresh, minlength=len(starts))
                    other = (inner[:, 2:4] != inner[starts[of], 2:4]).any(axis=1)
                    put(DROP, inner[other & (n_docs[of] >= min_docs)])
                run = _Run(tuple(rows[bounds[-2], :2]), True)
                feed(run, rows[bounds[-2] :])
            yield from made()
        if run is not None:
            put_sum(run)
            for x in run.held:  # whether there are more documents, the next range knows
                put(OPEN, x)
        yield from made()

    return decide


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, text_hash, pos``: the lines to drop, each once."""
    keys = ["h1", "h2", F.col("named").desc(), F.col("doc_id").desc(), "text_hash", "pos"]
    records = line_records(docs, doc_id, text, min_chars).repartitionByRange(*keys[:4]).sortWithinPartitions(*keys)
    found = staged(records.mapInArrow(_decider(min_docs), RECORD), "line-decisions")
    # sums of hashes at the edges of ranges: at most two rows per range
    last = F.struct("named", "doc_id")
    edges = found.filter(F.col("kind") == SUM).groupBy("h1", "h2").agg(F.sum("n_docs").alias("total"), F.max(last).alias("keeper")).filter(F.col("total") >= min_docs)
    late = found.filter(F.col("kind") == OPEN).drop("n_docs").join(F.broadcast(edges), ["h1", "h2"]).filter(last != F.col("keeper"))
    columns = [F.when(F.col("named") == 1, F.col("doc_id")).alias("doc_id"), "text_hash", "pos"]
    return found.filter(F.col("kind") == DROP).select(*columns).unionByName(late.select(*columns))


def pack_bitmap(n: int, dropped: np.ndarray) -> bytes:
    """A bit per line, set where it stays, deflated."""
    keep = np.ones(n, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack_bitmap(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n, bitorder="little").astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("dropped")
        maps = [pack_bitmap(n, np.array(lists[i].as_py(), np.int64)) for i, n in enumerate(batch.column("n_lines").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maps, pa.binary())], names=[*batch.schema.names, "keep"]).select(["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, text_hash, n_lines, n_dropped, keep`` for every document that loses lines, once per id and text.

    A line's key is the line stripped of ASCII white space at both ends, with A-Z lower-cased. Keys of
    at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines but those
    of the largest ``doc_id`` that holds them. ``keep`` has a bit per line (see ``unpack_bitmap``).

    Documents are told apart by ``doc_id``: rows of one id count as one document and each keeps its own
    lines, null is one id below all others. Null and empty texts have one empty line; texts and lines may have
    any length; repeated rows share a bitmap. An empty table gives none. Other columns are not read.
    """
    gone = dropped_lines(docs, doc_id, text, min_chars, min_docs)
    per_doc = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))
    sizes = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.size(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n_lines"))
    sizes = sizes.groupBy("id", "h").agg(F.max("n_lines").alias("n_lines"))
    both = per_doc.join(sizes, per_doc["doc_id"].eqNullSafe(sizes["id"]) & (per_doc["text_hash"] == sizes["h"]))
    rows = both.select("doc_id", "text_hash", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.array_sort("dropped").alias("dropped"))
    return rows.mapInArrow(_bitmaps, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


def _kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in chunks(batch):
            texts, maps = some.column("text").to_pylist(), some.column("keep").to_pylist()
            counts, dropped = [], []
            for i, (text, keep) in enumerate(zip(texts, maps)):
                lines = (text or "").split("\n")
                if keep is not None:
                    bits = unpack_bitmap(keep, len(lines))
                    texts[i] = "\n".join(x for x, k in zip(lines, bits.tolist()) if k)
                else:
                    texts[i] = text or ""
                counts.append(len(lines))
                dropped.append(len(lines) - int(bits.sum()) if keep is not None else 0)
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``doc_id, n_lines, n_dropped, kept``: its text without the dropped lines (null: empty)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    maps = bitmaps.select(F.col("doc_id").alias("id"), "text_hash", "keep")
    both = rows.join(maps, rows["doc_id"].eqNullSafe(maps["id"]) & (rows["h"] == maps["text_hash"]), "left").select("doc_id", "text", "keep")
    return both.mapInArrow(_kept_text, "doc_id long, n_lines long, n_dropped long, kept string")
