"""Pooling and repairing corpora: de-duplication, back-fill, reuse, verified joins, lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import join_on


def drop_maps(rows: DataFrame, column: str, excluded: Sequence[str], keep: Sequence[str] | None = None, clean: bool = True) -> DataFrame:
    """Default exclusion of defective groups, then an optional keep-set. ``clean=False`` opts out.

    An excluded group stays out even when the keep-set names it.
    """
    out = rows.filter(~F.coalesce(F.col(column).isin(*excluded), F.lit(False))) if clean and excluded else rows
    return out.filter(F.col(column).isin(*keep)) if keep is not None else out


def kept_dropped(rows: DataFrame, column: str, excluded: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """Kept and dropped row counts per group under ``drop_maps``."""
    ok = ~F.coalesce(F.col(column).isin(*excluded), F.lit(False))
    if keep is not None:
        ok = ok & F.col(column).isin(*keep)
    return rows.groupBy(column).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def match_fields(rows: DataFrame, **wanted) -> DataFrame:
    """Manifest filter. A list field must share an element with the wanted list or hold the
    wanted value; other fields must be equal; a missing field fails."""
    types = dict(rows.dtypes)
    cond = F.lit(True)
    for name, value in wanted.items():
        if name not in types:
            return rows.filter(F.lit(False))
        field = F.col(name)
        if types[name].startswith("array"):
            items = value if isinstance(value, (list, tuple)) else [value]
            hit = F.arrays_overlap(field, F.array(*[F.lit(v) for v in items]))
        else:
            hit = field == F.lit(value)
        cond = cond & F.coalesce(hit, F.lit(False))
    return rows.filter(cond)


def first_source(rows: DataFrame, key: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """One row per key: the one that comes first by ``rank``.

    A map-side-combined minimum, so a key that every source repeats costs one row per task.
    """
    other = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*other), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("__b"))
    return best.select(*key, "__b.*")


def name_collisions(rows: DataFrame, name: str, source: str) -> DataFrame:
    """Each (name, source) of the names that more than one source uses, with how many do."""
    pairs = rows.select(name, source).distinct()
    shared = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("n_sources")).filter("n_sources > 1")
    return join_on(pairs, shared, [name], "inner")


def backfill(primary: DataFrame, secondary: DataFrame, key: Sequence[str], group: str, source: Column, source_name: str = "source") -> DataFrame:
    """Primary rows plus the secondary groups that share no key with it; groups with any overlap stay out whole."""
    known = primary.select(*key).distinct().withColumn("__hit", F.lit(1))
    overlap = join_on(secondary.select(group, *[k for k in key if k != group]), known, key, "left")
    clean = overlap.groupBy(group).agg(F.count("__hit").alias("__n")).filter("__n = 0").select(group)
    extra = join_on(secondary, clean, [group], "left_semi").withColumn(source_name, source)
    return primary.unionByName(extra)


def overlap_report(primary: DataFrame, secondary: DataFrame, key: Sequence[str], group: str) -> DataFrame:
    """Per secondary group: rows, rows already in primary, and what happens to it."""
    known = primary.select(*key).distinct().withColumn("__hit", F.lit(1))
    g = join_on(secondary.select(group, *[k for k in key if k != group]), known, key, "left").groupBy(group)
    counts = g.agg(F.count(F.lit(1)).alias("n"), F.count("__hit").alias("dup"))
    fate = F.when(F.col("dup") == 0, "added").when(F.col("dup") < F.col("n"), "partial").otherwise("covered")
    return counts.withColumn("fate", fate)


def reuse_todo(rows: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Marks each row as ``reuse`` (key already computed) or ``todo``; never both, never neither."""
    known = done.select(*key).distinct().withColumn("__done", F.lit(True))
    return join_on(rows, known, key, "left").withColumn("action", F.when(F.col("__done"), "reuse").otherwise("todo")).drop("__done")


def pending(rows: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the output yet, for a resumable run."""
    return join_on(rows, done.select(*key).distinct(), key, "left_anti")


def verified_join(meta: DataFrame, side: DataFrame, key: Sequence[str], check: Sequence[str], stems: DataFrame, stem: str, complete: str | None = None) -> DataFrame:
    """Joins a side table on its key and accepts it only when all ``check`` columns agree.

    ``status`` says why not: no source for the stem, columns missing in it (``complete``
    false), or other values under the same key.
    """
    renamed = side.select(*key, *[F.col(c).alias(f"side_{c}") for c in check], F.lit(True).alias("__side"))
    listed = stems.select(stem, (F.col(complete) if complete else F.lit(True)).alias("__complete")).groupBy(stem).agg(F.min("__complete").alias("__complete"))
    out = join_on(join_on(meta, listed, [stem], "left"), renamed, key, "left")
    agree = F.col("__side").isNotNull()
    for c in check:
        agree = agree & F.col(c).eqNullSafe(F.col(f"side_{c}"))
    status = (
        F.when(F.col("__complete").isNull(), "source_unavailable")
        .when(~F.col("__complete"), "source_columns_missing")
        .when(agree, "verified")
        .otherwise("source_key_mismatch")
    )
    return out.withColumn("status", status).drop("__side", "__complete")


def cropped_meta(meta: DataFrame, new_length: str, exact_last: str, step: int) -> DataFrame:
    """Episode columns after a crop: exact last tick when verified, else estimated from the step."""
    changed = F.col(new_length) < F.col("n_ticks")
    estimate = F.col("last_tick") - (F.col("n_ticks") - F.col(new_length)) * step
    known = F.col(exact_last).isNotNull()
    return meta.select(
        *[c for c in meta.columns if c not in ("n_ticks", "last_tick", new_length, exact_last)],
        F.col(new_length).alias("n_ticks"),
        F.when(changed, F.coalesce(F.col(exact_last), estimate)).otherwise(F.col("last_tick")).alias("last_tick"),
        F.when(changed, F.col("n_ticks")).alias("original_n_ticks"),
        F.when(changed, F.col("last_tick")).alias("original_last_tick"),
        F.when(changed, F.when(known, "verified").otherwise("estimated")).alias("last_tick_source"),
    )


def upsert(table: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows replace the old rows of their key (index files, lineage with one generation each)."""
    return pending(table, new, key).unionByName(new)


def resolve_preferences(labels: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(chosen, rejected) texts of display-space choices; ``outcome`` also names ties, skips and orphans.

    ``labels(choice, first_shown)``, ``candidates(completion_a, completion_b)``.
    """
    joined = labels.join(candidates, key, "left")
    shown_swapped = F.coalesce(F.col("first_shown"), F.lit("A")) == "B"
    picked_a = (F.col("choice") == "A") != shown_swapped
    decided = F.col("choice").isin("A", "B") & F.col("completion_a").isNotNull()
    outcome = F.when(F.col("completion_a").isNull(), "orphan").when(decided, "pair").when(F.col("choice") == "tie", "tie").otherwise("skip")
    a, b = F.col("completion_a"), F.col("completion_b")
    return joined.select(
        key,
        outcome.alias("outcome"),
        F.when(decided, F.when(picked_a, a).otherwise(b)).alias("chosen"),
        F.when(decided, F.when(picked_a, b).otherwise(a)).alias("rejected"),
        F.when(F.col("choice").isin("A", "B"), F.when(picked_a, "A").otherwise("B")).otherwise(F.col("choice")).alias("canonical"),
    )


def indexed_join(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Joins two tables that describe the same rows by an explicit index; refuses unequal ones."""
    gaps = left.select(index).join(right.select(index, F.lit(1).alias("__r")), index, "full_outer").filter("__r IS NULL").limit(1).count()
    extra = join_on(right.select(index), left.select(index), [index], "left_anti").limit(1).count()
    if gaps or extra:
        raise ValueError(f"the two sides differ on {index}")
    return left.join(right, index)


def resolve_files(labels: DataFrame, files: DataFrame, stem: str, priors: str, allowed: DataFrame | None = None) -> DataFrame:
    """Labels with an existing file and, in order, the paths of the prior files that exist.

    ``files(stem, path)``; ``allowed`` optionally restricts to manifest ids.
    """
    rows = join_on(labels, allowed.select(stem).distinct(), [stem], "left_semi") if allowed is not None else labels
    rows = rows.join(files.select(stem, "path"), stem)
    listed = rows.select(stem, F.posexplode(priors).alias("pos", "__p"))
    found = listed.join(files.select(F.col(stem).alias("__p"), F.col("path").alias("prior_path")), "__p")
    gathered = found.groupBy(stem).agg(F.array_sort(F.collect_list(F.struct("pos", "prior_path"))).alias("__l"))
    out = rows.join(gathered, stem, "left")
    paths = F.coalesce(F.transform("__l", lambda x: x["prior_path"]), F.array().cast("array<string>"))
    return out.withColumn("prior_paths", paths).drop("__l")


def authored(rows: DataFrame, candidates: str, labels: Sequence[str], placeholder: str = "TODO") -> DataFrame:
    """Records whose candidate map has all labels and none that starts with the placeholder."""
    have = F.map_keys(candidates)
    complete = F.size(F.array_intersect(have, F.array(*[F.lit(x) for x in labels]))) == len(labels)
    written = F.forall(F.map_values(candidates), lambda v: ~v.startswith(placeholder))
    return rows.filter(complete & written)
