"""Benchmark decontamination: winnowed word k-grams find shared spans, which are then extended and verified.

Of every ``window`` consecutive words of a text exactly one k-gram is kept: the one with the least
hash, of equal hashes the rightmost. Two texts that share ``window`` consecutive words keep the
same k-gram of that span at the same place, so joining the kept k-grams misses no shared span.
Each match is extended to the benchmark's whole window and compared word by word.

Everything is built from DataFrame functions; documents are read once and never shuffled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, let_array, runs, staged
from tickloom.llm.winnow import coded, gram_hashes, hash_of, place_of, selected

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # Fixed value: the pattern of a word after A-Z are lower-cased
BROADCAST_BYTES = 32 << 20  # of the benchmark's windows, counted before they are sent to the tasks


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of all items with the k-gram each keeps, and which items hold which window.

    An item with fewer words than ``window`` is one window, kept under the hash of all its words.
    """
    words = benchmark.select(F.col(item).alias("item_id"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    spans = words.select("item_id", F.explode(let_array(F.col("words"), lambda w: runs(F.size(w) - size + 1, "array<string>", lambda i: F.slice(w, i, size)))).alias("span"))
    spans = spans.withColumn("window_id", F.md5(F.array_join("span", " ")))
    full = F.size("span") == window
    kept = F.array_min(coded(gram_hashes(F.col("span"), k)))
    shorter = F.lit(None).cast("bigint")
    for m in range(1, window):  # the hash of all words, made as for documents
        shorter = F.when(F.size("span") == m, hash_of(F.get(gram_hashes(F.col("span"), m), F.lit(0)))).otherwise(shorter)
    distinct = spans.groupBy("window_id").agg(F.first("span").alias("span"))
    windows = distinct.select(
        "window_id", "span", F.size("span").alias("size"), F.when(full, hash_of(kept)).otherwise(shorter).alias("hash"), F.when(full, place_of(kept)).otherwise(F.lit(0)).alias("place")
    )
    return windows, spans.select("window_id", "item_id").distinct()


def _every_gram(words: Column, m: int) -> Column:
    return F.transform(gram_hashes(words, m), lambda h, i: F.struct(i.alias("at"), F.lit(m).alias("kind"), hash_of(h).alias("hash")))


def window_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Where windows of the benchmark occur in documents.

    ``docs`` has ``row_id``, unique per document, and the text. The first result has a row per
    document with hits and one for every other document: ``row_id, n_words, at, window_id`` with
    ``at`` the first word of the occurrence (null: none). The second maps windows to items.
    """
    windows, members = benchmark_windows(benchmark, item, item_text, window, k)
    windows, members = staged(windows, "windows"), staged(members, "window-items")
    short = sorted(r["size"] for r in windows.filter(F.col("size") < window).select("size").distinct().collect())  # below `window` numbers
    words = docs.select("row_id", words_of(F.col(text)).alias("words"))
    grams = [F.transform(selected(gram_hashes(F.col("words"), k), window - k + 1), lambda c: F.struct(place_of(c).alias("at"), F.lit(window).alias("kind"), hash_of(c).alias("hash")))]
    grams += [_every_gram(F.col("words"), m) for m in short]
    nothing = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("hash")))
    grams = F.concat(nothing, *grams)  # every document keeps one row
    start = F.col("gram.at") - F.col("place")
    met = (F.col("gram.hash") == F.col("hash")) & (F.col("gram.kind") == F.col("size")) & (start >= 0)
    held = windows.agg(F.sum(F.octet_length(F.array_join("span", " ")) + 16 * F.size("span") + 100)).first()[0] or 0
    if held <= broadcast_bytes:
        rows = words.select("row_id", F.size("words").alias("n_words"), "words", F.explode(grams).alias("gram"))
        hits = rows.join(F.broadcast(windows), met & (F.slice("words", start + 1, F.col("size")) == F.col("span")), "left")
    else:  # a gram travels with the words that a window around it can reach, not with the whole text
        reach = window - k
        near = let_array(F.col("words"), lambda w: F.transform(grams, lambda g: F.struct(g["at"].alias("at"), g["kind"].alias("kind"), g["hash"].alias("hash"), F.slice(w, F.greatest(g["at"] - reach, F.lit(0)) + 1, F.lit(window + reach)).alias("around"))))
        rows = words.select("row_id", F.size("words").alias("n_words"), F.explode(near).alias("gram"))
        inside = start - F.greatest(F.col("gram.at") - reach, F.lit(0)) + 1
        hits = rows.join(windows, met & (F.slice("gram.around", F.greatest(inside, F.lit(1)), F.col("size")) == F.col("span")), "left")
    hits = hits.filter(F.col("window_id").isNotNull() | (F.col("gram.at") < 0))
    return hits.select("row_id", "n_words", F.when(F.col("window_id").isNotNull(), start).alias("at"), "window_id", "size"), members


def covered(spans: Column) -> Column:
    """How many places the spans ``struct(at, size)`` cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))

    def step(acc, s):
        end = s["at"] + s["size"]
        fresh = F.greatest(end - F.greatest(acc["end"], s["at"]), F.lit(0))
        return F.struct((acc["total"] + fresh).alias("total"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["total"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: ``row_id``, the id, ``text_hash, n_words, n_hit, n_items, items, spans, contaminated``.

    A word is hit if it lies in an occurrence of one of the benchmark's windows. ``items`` are the
    ids (as strings, sorted) of the items whose windows occur, ``spans`` the occurrences
    ``struct(at, size)``. Null or wordless texts have no words and no hits. Repeated rows and
    repeated or null ids are judged each by itself; a null item id counts as an item but is not
    listed. Empty tables give an empty result or no hits. Other columns are not read.
    """
    key = F.struct(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    hits, members = window_hits(docs.select(key.alias("row_id"), F.col(text).alias("text")), benchmark, "text", item, item_text, window, k, broadcast_bytes)
    spans = F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "size")))
    found = hits.groupBy("row_id").agg(F.max("n_words").cast("long").alias("n_words"), spans.alias("spans"), F.collect_set("window_id").alias("window_ids"))
    both = (
        found.select("row_id", "n_words", "spans", F.explode_outer("window_ids").alias("window_id"))
        .join(members.withColumn("known", F.lit(True)), "window_id", "left")
        .groupBy("row_id")
        .agg(
            F.first("n_words").alias("n_words"), F.first("spans").alias("spans"),
            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
            F.coalesce(F.max((F.col("known") & F.col("item_id").isNull()).cast("int")), F.lit(0)).alias("unnamed"),
        )
        .withColumn("n_items", (F.size("items") + F.col("unnamed")).cast("long"))
    )
    return both.select(
        F.col("row_id.row_id").alias("row_id"), F.col("row_id.doc_id").alias("doc_id"), F.col("row_id.text_hash").alias("text_hash"), "n_words", covered(F.col("spans")).alias("n_hit"), "n_items", "items",
        F.array_sort("spans").alias("spans"), (F.size("spans") > 0).alias("contaminated"),
    )
