"""Words and pairs of neighbouring words of texts, counted and made into vectors in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructType

from tickloom.session import scratch

WORD = re.compile(r"\w{2,}", re.ASCII)  # what cutting at \W+ leaves, without single characters


def _row_of(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch of texts, given as bytes, and the row of each."""
    found = [WORD.findall(x.decode(errors="replace").lower()) if x is not None else [] for x in texts.to_pylist()]
    return pa.array(list(chain.from_iterable(found)), pa.string()), _row_of(np.fromiter(map(len, found), "int64", len(found)))


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return _row_of(lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype("int64")


def _pairs(row: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours within a row as ``first * size + second``; words without a code (-1) form none."""
    met = (row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0)
    return row[1:][met], code[:-1][met] * size + code[1:][met]


def _tally(row: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of a batch, how often each comes and in how many rows."""
    each, n = np.unique(row * size + code, return_counts=True)
    codes, at = np.unique(each % size, return_inverse=True)
    return codes, np.bincount(at, n).astype("int64"), np.bincount(at)


def _most_frequent(counts: DataFrame, term: str, min_df: int, terms: int) -> list[tuple]:
    """At most ``terms`` terms of at least ``min_df`` rows with their counts, of equally frequent ones the least."""
    whole = counts.groupBy(term).agg(F.sum("n").alias("n"), F.sum("df").alias("df")).filter(F.col("df") >= min_df)
    return [(r[term], r["n"]) for r in whole.orderBy(F.desc("n"), term).limit(terms).collect()]


def _replaced(rows: DataFrame, column: str, name: str, kind: DataType, make: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``rows`` with ``column`` replaced by ``name``, which ``make`` derives from it batch by batch."""
    others = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], make(b.column(column))], [*others, name])

    return rows.mapInArrow(run, StructType([rows.schema[c] for c in others]).add(name, kind))


def word_counts(rows: DataFrame, text: str) -> DataFrame:
    """``word, n, df`` of texts given as bytes: occurrences and rows of each word, one row per word and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, row = _words(b.column(0))
            coded = words.dictionary_encode()
            codes, n, df = _tally(row, coded.indices.to_numpy().astype("int64"), len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes)), pa.array(n), pa.array(df)], ["word", "n", "df"])

    return rows.select(text).mapInArrow(run, "word string, n long, df long")


def word_codes(rows: DataFrame, text: str, name: str, words: Sequence[str]) -> DataFrame:
    """Texts given as bytes replaced by the places of their words in ``words``, in order; other words are -1."""
    known = list(words)

    def make(texts: pa.Array) -> pa.Array:
        found, row = _words(texts)
        at = pc.fill_null(pc.index_in(found, value_set=pa.array(known, pa.string())), -1)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32()), at)

    return _replaced(rows, text, name, ArrayType(IntegerType()), make)


def pair_counts(rows: DataFrame, codes: str, size: int) -> DataFrame:
    """``pair, n, df`` of neighbouring words of ``word_codes``, one row per pair and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pair = _pairs(*_coded(b.column(0)), size)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _tally(row, pair, size * size)], ["pair", "n", "df"])

    return rows.select(codes).mapInArrow(run, "pair long, n long, df long")


def frequent_words(rows: DataFrame, text: str, min_df: int, terms: int) -> dict[str, int]:
    """The ``terms`` most frequent words of at least ``min_df`` texts, in alphabetical order, with their counts."""
    return dict(sorted(_most_frequent(word_counts(rows, text), "word", min_df, terms)))


def frequent_terms(rows: DataFrame, codes: str, words: dict[str, int], min_df: int, terms: int) -> list[int]:
    """The ``terms`` most frequent words and pairs: a word as its code, a pair as ``len(words) + first * len(words) + second``.

    Of equally frequent ones words come first, then alphabetical order decides. A pair is no more frequent, and in no more texts, than
    either of its words. One with a word that is not in ``frequent_words`` so comes after all of these, and need not be counted.
    """
    pairs = _most_frequent(pair_counts(rows, codes, len(words)), "pair", min_df, terms)
    ranked = sorted([*[(-n, i) for i, n in enumerate(words.values())], *[(-n, len(words) + p) for p, n in pairs]])
    return [t for _, t in ranked[:terms]]


def term_vectors(rows: DataFrame, codes: str, name: str, size: int, vocabulary: Sequence[int]) -> DataFrame:
    """``word_codes`` replaced by sparse vectors of term counts, stored once.

    ``vocabulary`` holds a word as its code and a pair as ``size + first * size + second``.
    """
    from pyspark.ml.linalg import VectorUDT  # the tasks need no pyspark.ml

    kind = VectorUDT.sqlType()
    names = kind.names
    known = np.array(vocabulary, "int64")
    order = np.argsort(known)
    ranked = known[order]

    def make(lists: pa.Array) -> pa.Array:
        row, code = _coded(lists)
        pair_row, pair = _pairs(row, code, size)
        row, term = np.concatenate([row, pair_row]), np.concatenate([code, size + pair])
        at = np.searchsorted(ranked, term).clip(max=len(ranked) - 1)
        hit = ranked[at] == term
        each, n = np.unique(row[hit] * len(known) + order[at[hit]], return_counts=True)
        starts = pa.array(np.searchsorted(each // len(known), np.arange(len(lists) + 1)), pa.int32())
        indices, values = pa.array(each % len(known), pa.int32()), pa.array(n.astype("float64"))
        sparse, width = pa.array(np.zeros(len(lists)), pa.int8()), pa.array(np.full(len(lists), len(known)), pa.int32())
        return pa.StructArray.from_arrays([sparse, width, pa.ListArray.from_arrays(starts, indices), pa.ListArray.from_arrays(starts, values)], names)

    # a vector is stored as this struct and read back as what it is
    folder = scratch(rows.sparkSession, "vectors")
    _replaced(rows, codes, name, kind, make).write.parquet(folder)
    return rows.sparkSession.read.schema(StructType([rows.schema[c] for c in rows.columns if c != codes]).add(name, VectorUDT())).parquet(folder)
