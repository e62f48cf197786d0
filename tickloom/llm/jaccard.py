"""Exact Jaccard join of word-shingle sets by vertical partitioning, and its components.

Shingles are put into one global order, rare ones first; the frequencies come from a sketch of
fixed size that Spark adds up over all documents. Every set's prefix in this order holds at
least one shingle of any partner that is similar enough, so only documents that meet there are
compared. A compared pair's overlap is counted fragment by fragment: the shingle universe is cut
into ranges, the sets into one segment per range, the segments' overlaps are counted apart
and summed per pair.

Equal sets are one class from the start. Large groups of near copies don't become all pairs:
each class is first compared with the most central class it meets, and afterwards only pairs
of classes that these links have not joined yet. No candidate is left out, so the components
are those of the full join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import holds, staged, tidy
from tickloom.llm.encode import chunks

SKETCH_BITS = 22  # slots of the frequency sketch; 4 MB when sent to the tasks
PIECE = 1 << 16  # slots per row while the sketch is added up
FRAGMENTS = 8
BROADCAST_ROWS = 2_000_000  # ids that may be sent to every executor (about 32 MB)
CHUNK = 1 << 19  # bytes of text hashed at a time; the arrays take about 50 times as much

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_P = 0x9E3779B97F4A7C55 | 1
_powers: list[np.ndarray] = []
holds("jaccard", _powers.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a common finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        tables = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of all texts, and where each text's words start (one more at the end).

    Words are runs of anything but ASCII white space, A-Z count as a-z.
    """
    space = pa.scalar(" ", pa.large_string())
    joined = pa.concat_arrays([pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar("", pa.large_string()), space)])
    ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
    raw = _LOWER[np.frombuffer(joined.buffers()[2], np.uint8)[ends[0] : ends[-1]]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[1:] = ~_SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # every text ends with a space
    first, last = edges[0::2], edges[1::2]
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    words = _mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return words, np.searchsorted(first, ends - ends[0])


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    Fewer than ``k`` words are one shingle, none give an empty set.
    """
    words, starts = word_hashes(texts)
    grams = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        grams = _mix(grams + words[j : j + len(grams)] + np.uint64(j + 1))
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            one = np.zeros(1, dtype=np.uint64)
            for j, w in enumerate(words[a:b]):
                one = _mix(one + w + np.uint64(j + 1 + 100 * (b - a)))
            yield one
        else:
            yield words[:0]


def _class(s: np.ndarray) -> int:
    """One 64-bit name for equal sets."""
    both = np.array([_mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(s)], dtype=np.uint64)
    return int(_mix(_mix(both[:1]) + both[1:] + np.uint64(len(s)))[0].astype(np.int64))


def _slots(s: np.ndarray) -> np.ndarray:
    return (_mix(s) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _profile(k: int):
    """Per document its id, set size and class; per task its part of the frequency sketch."""

    def rows(*columns):
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "text_hash", "n", "cls", "piece", "counts"])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for some in chunks(batch, size=CHUNK):
                sets = list(shingle_sets(some.column("text"), k))
                names = [_class(s) if len(s) else None for s in sets]
                np.add.at(sketch, _slots(np.concatenate(sets)), np.uint32(1))
                none = [None] * len(sets)
                yield rows(some.column("doc_id"), some.column("text_hash"), [len(s) for s in sets], names, none, none)
        low = np.minimum(sketch, 65535).astype("<u2").reshape(-1, PIECE)
        for piece in np.flatnonzero(low.any(axis=1)):
            yield rows([None], [None], [None], [None], [piece], [zlib.compress(low[piece].tobytes(), 1)])

    return profile


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of the sketch and keeps the logarithm of each count in a byte."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(zlib.decompress(row["counts"]), "<u2")
            total[row["piece"]] = total.get(row["piece"], 0) + part.astype(np.int64)
    for piece, counts in total.items():
        levels = np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([levels.tobytes()])], names=["piece", "levels"])


def least_overlap(n: int, num: int, den: int) -> int:
    return (n * num + den - 1) // den


def _prefixes(k: int, num: int, den: int, levels: np.ndarray):
    """The shingles of each class's prefix in the global order (rare slots first, then by hash)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for some in chunks(batch, size=CHUNK):
                tokens, names, sizes, places = [], [], [], []
                for s in shingle_sets(some.column("text"), k):
                    n = len(s)
                    if not n or (name := _class(s)) in seen:
                        continue
                    seen.add(name)
                    p = n - least_overlap(n, num, den) + 1
                    tokens.append(s[np.argsort(levels[_slots(s)], kind="stable")[:p]])
                    names.append(np.full(p, name, np.int64))
                    sizes.append(np.full(p, n, np.int32))
                    places.append(np.arange(p, dtype=np.int32))
                if len(seen) > 1 << 20:
                    seen.clear()
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).astype(np.int64)), *(pa.array(np.concatenate(x)) for x in (names, sizes, places))],
                        names=["token", "cls", "n", "pos"],
                    )

    return prefixes


def _segments(k: int):
    """Each set cut into its fragments: ranges of equal width of the hashes."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, size=CHUNK):
                names, parts, arrays = [], [], []
                for s in shingle_sets(some.column("text"), k):
                    if len(s):
                        cuts = np.searchsorted(s, np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], dtype=np.uint64))
                        for f, seg in enumerate(np.split(s, cuts)):
                            if len(seg):
                                names.append(_class(s) if f == 0 or not names else names[-1])
                                parts.append(f)
                                arrays.append(seg.astype(np.int64))
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(parts, pa.int32()), pa.array(arrays, kind)], names=["cls", "fragment", "segment"])

    return segments


def _similar(small: Column, large: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(small, large) * den >= F.greatest(small, large) * num


def _at_least(a: Column, b: Column, num: int, den: int) -> Column:
    """The overlap that sets of these sizes need."""
    return F.ceil((a + b) * num / (num + den))


def _needed_in_prefix(a: Column, b: Column, num: int, den: int) -> Column:
    behind = F.greatest(F.ceil(a * num / den), F.ceil(b * num / den)) - 1
    return F.greatest(_at_least(a, b, num, den) - behind, F.lit(1))


def _enough_in_prefix(shared: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """Whether ``shared`` prefix shingles allow the needed overlap: what lies behind a prefix is bounded by its length."""
    return shared >= _needed_in_prefix(a, b, num, den)


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs ``a, b, na, nb`` of classes that are similar enough, counted fragment by fragment."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(reps, "cls").select("rep").distinct()
    ids = staged(ids, "candidates")
    small = ids.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    cut = texts.mapInArrow(tidy("jaccard", _segments(k)), "cls long, fragment int, segment array<long>").groupBy("cls", "fragment").agg(F.first("segment").alias("segment"))
    cut = staged(cut, "segments")
    left = pairs.join(cut.select(F.col("cls").alias("a"), "fragment", F.col("segment").alias("left")), "a")
    both = left.join(cut.select(F.col("cls").alias("b"), "fragment", F.col("segment").alias("right")), ["b", "fragment"])
    partial = F.size(F.array_intersect("left", "right"))
    shared = both.groupBy("a", "b", "na", "nb").agg(F.sum(partial).alias("shared"))
    return shared.filter(F.col("shared") * den >= (F.col("na") + F.col("nb") - F.col("shared")) * num).select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """``cls, comp`` for every class with a link: the least class it can reach.

    Each round takes the least label around, then the label of that label, until nothing changes.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        lower = labels.join(around, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("cls").alias("next"), F.col("comp").alias("further"))
        after = staged(lower.join(jump, "next", "left").select("cls", "old", F.least("next", F.coalesce("further", "next")).alias("comp")), "labels")
        if after.filter(F.col("old") != F.col("comp")).isEmpty():
            return after.select("cls", "comp")
        labels = after.select("cls", "comp")


def frequency_levels(profile: DataFrame) -> np.ndarray:
    """The sketch over all documents, one byte per slot (its size is fixed)."""
    parts = profile.filter(F.col("piece").isNotNull()).select("piece", "counts")
    summed = parts.repartition(16, "piece").mapInArrow(tidy("jaccard", _levels), "piece int, levels binary").collect()
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for row in summed:
        levels[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(row["levels"], np.uint8)
    return levels


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, text_hash, component``.

    Two documents are linked where ``den * |A & B| >= num * |A | B|`` for their sets of distinct
    ``k``-word shingles; ``component_id`` is the least id reachable by links, the document's own
    included. Words are runs of anything but ASCII white space, compared with A-Z lower-cased.
    A document with fewer than ``k`` words has one shingle, all its words; without words or text it
    has none and no link. Rows repeated under one id stay rows of their own; a null id never is
    the least of a component with other ids. ``text_hash`` tells rows of one id apart, ``component`` is a
    name of the component that is null for empty sets. Other columns are not read; an empty table gives none.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tagged = docs.withColumn("text_hash", F.xxhash64("text"))
    profile = staged(tagged.mapInArrow(tidy("jaccard", _profile(k)), "doc_id long, text_hash long, n long, cls long, piece int, counts binary"), "profile")
    each = profile.filter(F.col("piece").isNull()).select("doc_id", "text_hash", "n", "cls")
    reps = staged(each.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("rep")), "classes")

    levels = frequency_levels(profile)
    prefix = docs.select("text").mapInArrow(tidy("jaccard", _prefixes(k, num, den, levels)), "token long, cls long, n int, pos int")
    prefix = prefix.repartition("token").groupBy("token", "cls").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    buckets = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("pos", "cls", "n")).alias("head")).filter("m > 1")
    met = prefix.join(buckets, "token").select("token", "cls", "n", "pos", F.col("head.cls").alias("c"), F.col("head.n").alias("nc"))

    # what a class can share at all with partners whose prefix reaches as far in the global order or further:
    # shingles of its prefix that nobody else has in theirs count for none of these
    mine = Window.partitionBy("cls")
    met = met.withColumns({"met": F.count(F.lit(1)).over(mine), "before": F.row_number().over(mine.orderBy("pos")) - 1})
    met = staged(met.withColumn("most", F.ceil(F.col("n") * num / den) - 1 + F.col("met")), "meetings")

    # first the most central class each class meets
    star = met.filter((F.col("cls") != F.col("c")) & _similar(F.col("n"), F.col("nc"), num, den) & _enough_in_prefix(F.col("met"), F.col("n"), F.col("nc"), num, den))
    star = star.groupBy("cls", "c").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.first("nc").alias("nc"))
    best = star.groupBy("cls").agg(F.max(F.struct("shared", (-F.col("c")).alias("order"), "c", "n", "nc")).alias("x"))
    central = best.filter(_enough_in_prefix(4 * F.col("x.shared"), F.col("x.n"), F.col("x.nc"), num, den)).select(F.col("cls").alias("a"), F.col("x.c").alias("b"), F.col("x.n").alias("na"), F.col("x.nc").alias("nb"))
    first = staged(verified(staged(central, "pairs"), docs, reps, k, num, den), "links")
    joined = connected(first)

    # then every pair that meets and isn't joined yet
    labelled = met.join(joined, "cls", "left").select("token", "cls", "n", "pos", "met", "most", "before", F.coalesce("comp", "cls").alias("comp"))
    labelled = staged(labelled, "meetings")
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
    open_ = labelled.join(mixed, "token")
    x, y = open_.alias("x"), open_.alias("y")
    need = _at_least(F.col("x.n"), F.col("y.n"), num, den)
    # shared shingles before this one, this one, and what can follow it
    reach = F.least("x.before", "y.before") + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    # a pair that is similar enough shares all but a few of either's shingles that met anybody, so
    # the first few of the one with fewer such shingles find it
    fewer = F.struct("x.met", "x.cls") < F.struct("y.met", "y.cls")
    at = F.when(fewer, F.col("x.before")).otherwise(F.col("y.before"))
    keys = F.least("x.met", "y.met") - _needed_in_prefix(F.col("x.n"), F.col("y.n"), num, den) + 1  # none where either met too few
    meets = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.comp") != F.col("y.comp"))
        & _similar(F.col("x.n"), F.col("y.n"), num, den) & (reach >= need) & (F.greatest("x.most", "y.most") >= need) & (at < keys)
    )
    rest = staged(x.join(y, meets).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct(), "pairs")
    listed = met.groupBy("cls").agg(F.collect_list("token").alias("tokens"))  # as many as a prefix is long
    rest = rest.join(listed.select(F.col("cls").alias("a"), F.col("tokens").alias("left")), "a").join(listed.select(F.col("cls").alias("b"), F.col("tokens").alias("right")), "b")
    shared = F.size(F.array_intersect("left", "right"))
    rest = rest.filter(_enough_in_prefix(shared, F.col("na"), F.col("nb"), num, den)).select("a", "b", "na", "nb")
    second = staged(verified(staged(rest, "pairs"), docs, reps, k, num, den), "links")

    comps = connected(first.union(second))
    named = reps.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = named.join(least, "comp").select("cls", "component_id", F.col("comp").alias("component"))
    return each.join(of_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "component")


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Which rows go so that one document of each component stays, and which of the staying ones are repeated.

    The row with the least id (null last), of equal ids the least text hash, stays. Both results
    have ``doc_id, text_hash``.
    """
    found = staged(components(docs, doc_id, text, k, num, den), "components")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    stays = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("stays"))
    judged = found.join(stays, "component")
    gone = judged.filter(~order.eqNullSafe(F.col("stays"))).select("doc_id", "text_hash").distinct()
    again = judged.filter(order.eqNullSafe(F.col("stays"))).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return gone, again
