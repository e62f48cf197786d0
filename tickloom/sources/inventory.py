"""File inventories: which stems have which files, labelled or not, checksums."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.ordered import join_on
from tickloom.sources import local
from tickloom.sources.digests import file_digests

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp")


def list_files(spark: SparkSession, folder: str, suffixes: Sequence[str] = (), with_sha: bool = False) -> DataFrame:
    """``path, name, stem, suffix, bytes`` (and ``sha256``) of the files under a folder; empty ones are not listed.

    Content is only read when a checksum is asked for, a few megabytes at a time.
    """
    inner = local.place(folder)
    if inner and os.path.isdir(inner):
        files = local.listed(spark, inner, suffixes).select(F.concat(F.lit("file:"), "path").alias("path"), F.col("bytes").alias("length"))
    else:
        glob = "*.{" + ",".join(suffixes) + "}" if suffixes else "*"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    cols = [
        "path",
        name.alias("name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"),
        F.col("length").alias("bytes"),
    ]
    rows = files.select(*cols)
    return rows.join(file_digests(rows), ["path", "bytes"]).select(*rows.columns, "sha256") if with_sha else rows


def labelled(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Files whose stem has a label."""
    return join_on(files, labels.select("stem").distinct(), ["stem"], "left_semi")


def unlabelled(files: DataFrame, labels: DataFrame) -> DataFrame:
    return join_on(files, labels.select("stem").distinct(), ["stem"], "left_anti")


def label_stats(files: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: total, labelled and unlabelled files."""
    known = labels.select("stem").distinct().withColumn("__l", F.lit(1))
    joined = join_on(files, known, ["stem"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"), F.count("__l").alias("labeled"), (F.count(F.lit(1)) - F.count("__l")).alias("unlabeled")
    )


def registry(rows: DataFrame, kinds: Sequence[str], stem: str = "stem", kind: str = "kind") -> DataFrame:
    """One row per stem with a 0/1 column per kind of file."""
    return rows.groupBy(stem).agg(*[F.max((F.col(kind) == k).cast("long")).alias(f"has_{k}") for k in kinds])


def folder_sizes(files: DataFrame) -> DataFrame:
    """Files and megabytes per suffix."""
    return files.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("bytes") / (1024 * 1024), 3).alias("mb"))
