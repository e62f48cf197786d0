"""Reports about tables: coverage, invariants, integrity, gaps, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import join_on, ranked


def coverage(rows: DataFrame, buckets: dict[str, Sequence[str]], grid: tuple[str, Sequence[Sequence[int]]] | None = None, few: int = 0) -> DataFrame:
    """Counts per bucket kind, grid cells nobody falls into (``gap``) and thin cells (``few``)."""

    def label(columns):
        return F.concat_ws("v", *[F.col(c).cast("string") for c in columns])

    parts = [
        rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), label(cols).alias("bucket"), "n")
        for kind, cols in buckets.items()
    ]
    if grid:
        kind, axes = grid
        cols = buckets[kind]
        cells = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in axes[0]])).alias(cols[0]))
        for c, axis in zip(cols[1:], axes[1:]):
            cells = cells.select("*", F.explode(F.array(*[F.lit(v) for v in axis])).alias(c))
        counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        missing = join_on(cells, counted.select(*cols), cols, "left_anti")
        parts.append(missing.select(F.lit("gap").alias("kind"), label(cols).alias("bucket"), F.lit(0).cast("long").alias("n")))
        parts.append(counted.filter(F.col("n") < few).select(F.lit("few").alias("kind"), label(cols).alias("bucket"), "n"))
    return reduce(DataFrame.unionByName, parts)


def invariant_report(rows: DataFrame, rules: dict[str, Column], episode: Sequence[str], example: Sequence[str]) -> DataFrame:
    """Per broken rule: bad rows, bad episodes and the first example.

    ``rules`` are columns that are true on a violation. Rules are counted per episode first,
    so an episode of any size contributes one row per rule to the report.
    """
    where = F.struct(*[F.col(c) for c in example])
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    flags = rows.select(*episode, where.alias("__at"), F.explode(broken).alias("rule"))
    per = flags.groupBy("rule", *episode).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    report = per.groupBy("rule").agg(F.sum("n").alias("bad_rows"), F.count(F.lit(1)).alias("bad_episodes"), F.min("first").alias("first"))
    return report.orderBy("rule")


def violations(report: DataFrame) -> list[str]:
    """Messages of a report (one per broken rule), for a writer that must refuse bad data."""
    return [f"{r['rule']}: {r['bad_rows']} rows in {r['bad_episodes']} episodes (first at {tuple(r['first'])})" for r in report.collect()]


def require_clean(report: DataFrame) -> None:
    found = violations(report)
    if found:
        raise ValueError("; ".join(found))


def require_single(rows: DataFrame, column: str, what: str) -> None:
    """Refuses a table that mixes several values of ``column`` (schema versions)."""
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    seen = counted.orderBy(column).limit(9).collect()
    if len(seen) > 1:
        more = counted.count() - len(seen)
        raise ValueError(f"mixed {what}: {[(r[0], r['n']) for r in seen]}" + (f" and {more} more" if more else ""))


def require_scope(episodes: DataFrame, column: str, allowed: Sequence[str], expected: int, held_out: Sequence[str] = ()) -> None:
    """Refuses a fit whose episodes are not exactly the agreed scope."""
    row = episodes.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(column).isin(*held_out) if held_out else F.lit(False)).alias("leaked"),
        F.count_if(~F.col(column).isin(*allowed)).alias("foreign"),
    ).first()
    problems = [
        f"{row['n']} episodes, expected {expected}" if row["n"] != expected else "",
        f"{row['leaked']} held-out episodes" if row["leaked"] else "",
        f"{row['foreign']} episodes out of scope" if row["foreign"] else "",
    ]
    if any(problems):
        raise ValueError("; ".join(p for p in problems if p))


def id_differences(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Ids that are missing on either side or null, with how often."""
    a = have.groupBy(key).agg(F.count(F.lit(1)).alias("n_have"))
    b = want.groupBy(key).agg(F.count(F.lit(1)).alias("n_want"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col(key).isNull(), "null").when(F.col("n_want").isNull(), "extra").when(F.col("n_have").isNull(), "missing")
    return both.withColumn("status", status).filter("status IS NOT NULL")


def integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of each file against the manifest: both hold ``name, sha256, bytes``."""
    m = manifest.select("name", F.col("sha256").alias("want_sha"), F.col("bytes").alias("want_bytes"), F.lit(True).alias("__m"))
    f = files.select("name", "sha256", "bytes", F.lit(True).alias("__f"))
    status = (
        F.when(F.col("__f").isNull(), "MISSING")
        .when(F.col("__m").isNull(), "NO ENTRY")
        .when(F.col("want_bytes").isNotNull() & (F.col("want_bytes") != F.col("bytes")), "SIZE MISMATCH")
        .when(F.col("want_sha") == F.col("sha256"), "OK")
        .otherwise("MISMATCH")
    )
    return f.join(m, "name", "full_outer").select("name", status.alias("status"))


def table_digest(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free fingerprint: row count and the sum of the row hashes."""
    cols = [F.col(c) for c in (columns or sorted(rows.columns))]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string").alias("digest"))


def tick_gaps(rows: DataFrame, episode: Sequence[str], order: str, step: int) -> DataFrame:
    """Share of grid ticks between first and last that are absent, per episode."""
    ticks = rows.select(*episode, order).distinct()
    g = ticks.groupBy(*episode).agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count(F.lit(1)).alias("present"))
    expected = F.floor((F.col("b") - F.col("a")) / step) + 1
    return g.select(*episode, "present", expected.alias("expected"), (1 - F.col("present") / expected).alias("missing_share"))


def column_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long profile: min, mean, max and share of non-zero values per column."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.min(v).alias("lo"), F.avg(v).alias("mean"), F.max(v).alias("hi"), F.avg((v != 0).cast("double")).alias("rate")).alias(c))
    return rows.agg(*aggs).select(F.inline(F.array(*[F.col(c) for c in columns])))


def vocabulary(rows: DataFrame, column: str, missing: str = "<missing>") -> DataFrame:
    """Ids of the sorted distinct values; 0 is the missing token.

    Ranked by the number of the first six bytes, then the word, so the sort is distributed.
    """
    words = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("word")).distinct()
    head = F.rpad(F.substring(F.hex(F.encode("word", "UTF-8")), 1, 12), 12, "0")
    numbered = ranked(words.withColumn("__head", F.conv(head, 16, 10).cast("long")), [], "__head", "id", tie=["word"])
    first = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("id"), F.lit(missing).alias("word"))
    return first.unionByName(numbered.select(F.col("id").cast("long").alias("id"), "word"))


def split_counts(episodes: DataFrame, stratum: str, split: str, low: float = 0.08, high: float = 0.30) -> DataFrame:
    """Train and validation counts per stratum, the validation share and a skew flag."""
    g = episodes.groupBy(stratum).agg(F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "val").alias("val"))
    share = F.col("val") / (F.col("train") + F.col("val"))
    return g.withColumns({"share": share, "skewed": ~share.between(low, high)})


def histogram(rows: DataFrame, score: str, buckets: int) -> DataFrame:
    """Counts in equal bins of [0, 1]; values outside fall into the end bins. Empty bins stay."""
    index = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1))).cast("long")
    counted = rows.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(buckets).select(F.col("id").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
