"""Document fingerprints by winnowing.

A text is read as units: runs of up to eight letters or digits, and every other visible
character by itself. Each k-gram of units is hashed; of every ``span`` consecutive hashes the
least is kept, of equal ones the rightmost, together with its place. Two texts that share
``k + span - 1`` consecutive units therefore share a kept hash.

Only DataFrame functions are used; hashing and selection are array work inside one row.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import let, runs

UNIT = r"[\p{L}\p{N}]{1,8}|[^\s\p{L}\p{N}]"
PLACE_BITS = 31  # no text has more units: a Spark string holds less than 2**31 bytes
PLACES = (1 << PLACE_BITS) - 1  # lower bits of a code: the place counted down; the upper 33 bits are the hash


def gram_hashes(words: Column, k: int) -> Column:
    """64-bit hash of the k-gram that starts at each word."""
    each = F.transform(words, lambda w: F.xxhash64(w))
    return let(each, lambda h: runs(F.size(h) - (k - 1), "bigint", lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(k)])))


def coded(hashes: Column) -> Column:
    """Hash and place in one number, so that the rightmost of equal hashes is the least."""
    return F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.lit(PLACES) - i))


def place_of(code: Column) -> Column:
    """The place (from 0) of a code."""
    return (F.lit(PLACES) - code.bitwiseAND(F.lit(PLACES))).cast("int")


def hash_of(code: Column) -> Column:
    return F.shiftright(code, PLACE_BITS)


def selected(hashes: Column, span: int) -> Column:
    """Winnowing: for each run of ``span`` hashes the code of its least, rightmost of equal ones.

    Distinct codes in order of place. Fewer hashes than ``span`` give none.
    """
    least = let(coded(hashes), lambda c: runs(F.size(c) - (span - 1), "bigint", lambda i: F.least(*[F.get(c, i + (j - 1)) for j in range(span)])))
    # places never go back from one run to the next, so equal ones are neighbours
    return let(least, lambda x: F.filter(x, lambda e, i: (i == 0) | (e != F.get(x, i - 1))))


def fingerprint_codes(text: Column, k: int = 3, span: int = 4) -> Column:
    """The codes of the kept hashes of a text in order of place.

    A text with fewer than ``k`` units has the one hash of all of them, one with fewer than
    ``k + span - 1`` keeps the least of its hashes; without units, or null, the fingerprint is empty.
    """
    none = F.array().cast("array<bigint>")

    def of(units: Column) -> Column:
        n = F.size(units)
        grams = F.when(n >= k, gram_hashes(units, k)).when(n > 0, F.array(F.xxhash64(units))).otherwise(none)
        return let(grams, lambda h: F.when(F.size(h) >= span, selected(h, span)).when(F.size(h) > 0, F.array(F.array_min(coded(h)))).otherwise(none))

    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    return let(units, of)


def fingerprint(text: Column, k: int = 3, span: int = 4) -> Column:
    """The kept hashes of a text with their places, ``struct(at, hash)`` in order of place."""
    return F.transform(fingerprint_codes(text, k, span), lambda c: F.struct(place_of(c).alias("at"), hash_of(c).alias("hash")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the kept hashes of two fingerprints (as codes); two empty ones are alike (1)."""
    pair = F.struct(*[F.transform(f, hash_of).alias(n) for f, n in ((a, "a"), (b, "b"))])

    def of(p: Column) -> Column:
        either = F.size(F.array_union(p["a"], p["b"]))
        return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(p["a"], p["b"])) / either)

    return let(pair, of)


def _long(value: int | None) -> str:
    return "CAST(NULL AS BIGINT)" if value is None else f"CAST('{value}' AS BIGINT)"


def with_next(docs: DataFrame, doc_id: str, text: str, rows_per_bucket: int = 4000) -> DataFrame:
    """Each document's ``doc_id, text, fp`` (codes) with ``next_text, next_fp`` of the next one.

    The order is ascending ``doc_id`` (null first), of equal ids by a hash of the text, then the
    text; after the last document comes the first. Documents are dealt once, by quantiles of the
    id, into buckets of about ``rows_per_bucket`` rows; the first row of each bucket also goes
    behind the last row of the bucket before it, so no order spans more than a bucket. The
    driver holds only the buckets' bounds.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)))
    wanted = max(1, docs.count() // rows_per_bucket)
    bounds = rows.approxQuantile("place", [i / wanted for i in range(1, wanted)], 0.1 / wanted) if wanted > 1 else []
    bucketizer = Bucketizer(splits=[float("-inf"), *sorted(set(bounds)), float("inf")], inputCol="place", outputCol="bucket") if bounds else None
    rows = bucketizer.transform(rows).drop("place") if bucketizer else rows.drop("place").withColumn("bucket", F.lit(0))
    rows = rows.withColumn("bucket", F.col("bucket").cast("int"))  # as a double it would be dealt out once more for the window
    rows = rows.withColumn("ghost", F.lit(False))
    order = ["doc_id", "tie", "text"]
    least = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "tie")).alias("first"))
    firsts = sorted(((r["bucket"], r["first"]["doc_id"], r["first"]["tie"]) for r in least.collect()), key=lambda x: x[0])  # one row per bucket
    if not firsts:
        return rows.select("doc_id", "text", fingerprint_codes(F.col("text")).alias("fp"), F.col("text").alias("next_text"), fingerprint_codes(F.col("text")).alias("next_fp"))
    values = ", ".join(f"({b}, {_long(i)}, {_long(t)}, {firsts[k - 1][0]})" for k, (b, i, t) in enumerate(firsts))
    heads = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS heads(b, i, t, before)")
    copies = rows.join(heads, (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
    copies = copies.groupBy("b").agg(F.min(F.struct("text", "doc_id", "tie", "before")).alias("x")).select("x.doc_id", "x.text", "x.tie", F.col("x.before").alias("bucket"), F.lit(True).alias("ghost"))
    both = rows.select(*copies.columns).unionByName(copies)
    both = both.repartition("bucket").withColumn("fp", fingerprint_codes(F.col("text")))
    over = W.partitionBy("bucket").orderBy("ghost", *order)
    led = both.withColumn("next_text", F.lead("text").over(over)).withColumn("next_fp", F.lead("fp").over(over))
    return led.filter(~F.col("ghost")).select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, span: int = 4) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint of every whole text (null: empty). Other columns are not read;
    repeated rows have equal fingerprints; an empty table gives none."""
    return docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), k, span).alias("fp"))


def half_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How far fingerprints tell a half rewritten text from an unrelated one.

    For every document the last ``floor(n / 2)`` of its n characters are replaced by as many first
    characters of the next document. Columns: ``doc_id, n_chars, edited, fp, edited_fp, near_edited, near_next``;
    the fingerprints are codes (see ``place_of`` and ``hash_of``).
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs, doc_id, text).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    rows = rows.withColumn("edited_fp", fingerprint_codes(F.col("edited")))
    return rows.select("doc_id", "n_chars", "edited", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
