"""Writers: partitioned frames, JSON lines, nested episode documents, manifests."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.corpus import pending, upsert
from tickloom.operators.ordered import join_on, ranked
from tickloom.sources import local

PART_RECORDS = 100_000  # records of an array, which is one row when written and read
PART_ROWS = 1_000_000  # rows of a recording that one task writes


def write_frames(rows: DataFrame, path: str, by: Sequence[str] = ("split", "map_name"), mode: str = "errorifexists") -> None:
    """Frames as Parquet, partitioned for pruning.

    Refuses to overwrite by default; Spark's commit protocol publishes complete files only.
    The extra hash keeps one large partition value from becoming one file and one task.
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c not in by]), F.lit(64))
    rows.repartition(*[F.col(c) for c in by], spread).write.mode(mode).option("maxRecordsPerFile", 5_000_000).partitionBy(*by).parquet(path)


def _parts(rows: DataFrame, stem: str, limit: int) -> DataFrame:
    """Adds ``__part``: recordings of more than ``limit`` rows are dealt over as many parts as that takes (on average ``limit`` rows each)."""
    large = rows.groupBy(stem).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    counted = join_on(rows.withColumn("__row", F.monotonically_increasing_id()), large, [stem], "left")
    dealt = F.pmod(F.xxhash64("__row"), F.ceil(F.coalesce("__n", F.lit(1)) / limit))
    return counted.withColumn("__part", dealt.cast("int")).drop("__n", "__row")


def _named_files(spark: SparkSession, staging: str, folder: str, column: str, kind: str) -> None:
    """Moves the files of each partition folder to ``<stem>_<kind>.<extension>``, further ones to ``<stem>.part<n>_<kind>.<extension>``; a step per file."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(paths(folder))
    moved = Counter()
    for status in [*fs.globStatus(paths(f"{staging}/{column}=*/part-*")), *fs.globStatus(paths(f"{staging}/{column}=*/__part=*/part-*"))]:
        path = status.getPath()
        home, name = path.getParent(), path.getName()
        home = home.getParent() if home.getName().startswith("__part=") else home
        stem = home.getName().split("=", 1)[1]
        part = f".part{moved[stem]}" if moved[stem] else ""
        moved[stem] += 1
        fs.rename(path, paths(f"{folder}/{stem}{part}_{kind}.{name.rsplit('.', 1)[1] if not name.endswith('.txt') else 'json'}"))
    fs.delete(paths(staging), True)


def write_recordings(rows: DataFrame, folder: str, stem: str, kind: str) -> None:
    """Parquet files ``<stem>_<kind>.parquet`` per recording, which continues in ``<stem>.part<n>_<kind>.parquet``; no task holds a large recording whole."""
    staging = f"{folder}/.staging-{kind}"
    _parts(rows, stem, PART_ROWS).repartition(stem, "__part").drop("__part").write.option("maxRecordsPerFile", 2 * PART_ROWS).partitionBy(stem).parquet(staging)
    _named_files(rows.sparkSession, staging, folder, stem, kind)


def write_arrays(rows: DataFrame, folder: str, stem: str, kind: str) -> None:
    """Files ``<stem>_<kind>.json`` with one array of records per recording.

    A recording of more than ``PART_RECORDS`` records continues with further arrays in
    ``<stem>.part<n>_<kind>.json``; ``read_events`` reads all of them as one recording.
    """
    staging = f"{folder}/.staging-{kind}"
    record = F.struct(*[c for c in rows.columns if c != stem])
    lists = _parts(rows, stem, PART_RECORDS).groupBy(stem, "__part").agg(F.to_json(F.collect_list(record)).alias("value"))
    lists.write.partitionBy(stem, "__part").text(staging)
    _named_files(rows.sparkSession, staging, folder, stem, kind)


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_documents(rows: DataFrame, folder: str) -> None:
    """A JSON file per row, in a folder per task."""
    # a small table of many rows is read in a task or two, which would write all the files
    spread = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    inner = local.place(folder)
    if inner is None:
        spread.write.option("maxRecordsPerFile", 1).json(folder)
    else:
        local.write_texts(spread.select(F.to_json(F.struct(*rows.columns)).alias("value")), inner)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_missing(rows: DataFrame, existing: DataFrame, key: Sequence[str], path: str) -> None:
    """Resumable write: only keys the output does not have yet."""
    pending(rows, existing, key).write.mode("append").parquet(path)


def publish_clean(rows: DataFrame, staging: str, path: str, verify: Callable[[DataFrame], None], **kw) -> None:
    """Writes to staging, verifies what was written, then publishes; nothing is published on failure."""
    rows.write.mode("overwrite").parquet(staging)
    staged = rows.sparkSession.read.parquet(staging)
    verify(staged)
    write_frames(staged, path, **kw)


def schema_document(rows: DataFrame, version: str, vocabularies: dict[str, Sequence[str]]) -> DataFrame:
    """One row describing a table: version, schema as JSON and its vocabularies."""
    spark = rows.sparkSession
    vocab = F.create_map(*[x for k, v in vocabularies.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    return spark.range(1).select(F.lit(version).alias("version"), F.lit(rows.schema.json()).alias("schema"), vocab.alias("vocabularies"))


def nest_frames(rows: DataFrame, episode: Sequence[str], order: str, columns: Sequence[str], tie: Sequence[str] = (), per_part: int = 10_000) -> DataFrame:
    """Episode documents: ``frames`` sorted by ``order``, numbered parts of ``per_part`` frames.

    An episode of usual length is one document (part 0); a longer one continues in further
    parts, so no document and no task holds an unbounded episode.
    """
    placed = ranked(rows, episode, order, "__pos", tie=tie).withColumn("part", F.floor((F.col("__pos") - 1) / per_part))
    entry = F.struct("__pos", order, *[F.col(c) for c in columns])
    docs = placed.groupBy(*episode, "part").agg(F.array_sort(F.collect_list(entry)).alias("frames"))
    names = [c for c in (order, *columns)]
    return docs.withColumn("frames", F.transform("frames", lambda f: F.struct(*[f[c].alias(c) for c in names])))


def upsert_index(index: DataFrame, entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """Index rows with the new entries in place of the old ones of the same key."""
    return upsert(index, entries, key)
