"""Queries that write files and read them back through the package's own sinks and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import quality
from tickloom.plans.corpora import scratch
from tickloom.plans.registry import ACTIVITY, Tables, query
from tickloom.sources import digests, inventory, readers, sinks


def stem():
    return F.format_string("rec%d", F.col("user_id") % 10)


def second():
    return F.floor(F.col("us") / 1_000_000)


@query(
    "tick_files",
    "S1",
    f"""WITH {ACTIVITY} SELECT 'rec' || (user_id % 10) AS demo_stem, count(*) AS n, count(DISTINCT user_id) AS players, sum(us // 1000000 % 100000)::BIGINT AS ticks, round(sum(value), 4) AS x FROM activity GROUP BY 1""",
)
def tick_files(t: Tables):
    folder = scratch(t)
    rows = t.activity.select(stem().alias("stem"), (second() % 100000).cast("int").alias("tick"), F.col("user_id").alias("steamid"), F.col("value").alias("X"))
    sinks.write_recordings(rows, folder, "stem", "ticks")
    ticks = readers.read_ticks(t.spark, f"{folder}/*_ticks.parquet", ["tick", "steamid", "X"])
    return ticks.groupBy("demo_stem").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("steamid").alias("players"), F.sum("tick").alias("ticks"), F.round(F.sum("X"), 4).alias("x")
    )


@query(
    "event_arrays",
    "S3 U2",
    f"""WITH {ACTIVITY} SELECT 'rec' || (user_id % 10) AS demo_stem, CASE event_type WHEN 'error' THEN 'kills' ELSE 'bomb' END AS kind, count(*) AS n, sum(us // 1000000 % 100000)::BIGINT AS ticks FROM activity WHERE event_type IN ('error', 'click') GROUP BY 1, 2""",
)
def event_arrays(t: Tables):
    """Lists of two event kinds as arrays of records, one file per recording; a third kind has no files."""
    folder = scratch(t)
    rows = t.activity.select(stem().alias("stem"), (second() % 100000).cast("int").alias("tick"), "event_type")
    for kind, event in (("kills", "error"), ("bomb", "click")):
        sinks.write_arrays(rows.filter(F.col("event_type") == event).select("stem", "tick"), folder, "stem", kind)
    parts = [readers.read_events(t.spark, folder, kind).select("demo_stem", F.lit(kind).alias("kind"), "tick") for kind in ("kills", "bomb", "damages")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("demo_stem", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("tick").alias("ticks"))


@query(
    "label_files",
    "S7 S8",
    """SELECT count(*) AS total, count(*) FILTER (doc_id % 9 <> 2) AS readable, count(*) FILTER (doc_id % 9 = 2) AS unreadable, sum(quality) FILTER (doc_id % 9 <> 2)::BIGINT AS quality, count(*) FILTER (doc_id % 9 <> 2) AS labeled, count(*) FILTER (doc_id % 9 = 2) AS unlabeled, count(*) AS json_files FROM labels""",
)
def label_files(t: Tables):
    """One document per file; unreadable ones are told apart, and the inventory counts files with and without a label."""
    folder = scratch(t)
    body = F.when(F.col("doc_id") % 9 == 2, F.lit("not a number")).otherwise(F.col("quality").cast("string"))
    sinks.write_documents(t.labels.select("doc_id", body.alias("quality")), folder)
    good, bad = readers.read_label_files(t.spark, folder, "doc_id bigint, quality string")
    readable = good.withColumn("quality", F.expr("try_cast(quality AS INT)"))
    files = inventory.list_files(t.spark, folder, ["json"])
    named = readable.filter("quality IS NOT NULL")
    sums = readable.agg(F.count("quality").alias("readable"), F.count_if(F.col("quality").isNull()).alias("bad"), F.sum("quality").alias("quality"))
    stats = inventory.label_stats(files, named)
    sizes = inventory.folder_sizes(files).agg(F.sum("n").alias("json_files"))
    broken = bad.agg(F.count(F.lit(1)).alias("broken"))
    return stats.join(sums).join(sizes).join(broken).select(
        "total", "readable", (F.col("bad") + F.col("broken")).alias("unreadable"), "quality", "labeled", "unlabeled", "json_files"
    )


@query(
    "lines_appended_once",
    "S6 S12 S14",
    """SELECT o_orderpriority AS priority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, count(*) AS resumed FROM orders GROUP BY 1""",
)
def lines_appended_once(t: Tables):
    """A third as lines, the rest appended, then a resumed run that adds only what is missing."""
    lines, table = scratch(t), scratch(t)
    rows = t.orders.select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderpriority").alias("priority"))
    sinks.write_lines(rows.filter("id % 3 = 0"), lines)
    sinks.append_lines(rows.filter("id % 3 <> 0"), lines)
    read = readers.read_lines(t.spark, lines, "id bigint, priority string")
    read.filter("id % 2 = 0").write.parquet(table)
    sinks.append_missing(read, t.spark.read.parquet(table), ["id"], table)
    resumed = t.spark.read.parquet(table).groupBy("priority").agg(F.count(F.lit(1)).alias("resumed"))
    return read.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("keys")).join(resumed, "priority")


@query("schema_documents", "S11", """SELECT 'v2' AS version, 8 AS n_fields, 3 AS n_flags, (SELECT count(DISTINCT event_type) FROM events)::INTEGER AS n_types""")
def schema_documents(t: Tables):
    """The document beside a table: version, fields and vocabularies, written and read back."""
    path = scratch(t)
    types = [r[0] for r in t.events.select("event_type").distinct().orderBy("event_type").collect()]
    doc = sinks.schema_document(t.part.withColumns({"a": F.lit(1), "b": F.lit(2)}), "v2", {"flags": ["A", "N", "R"], "types": types})
    sinks.write_lines(doc, path)
    read = t.spark.read.schema("version string, schema string, vocabularies map<string,array<string>>").json(path)
    n = F.size(F.from_json(F.get_json_object("schema", "$.fields"), "array<string>"))
    return read.select("version", n.alias("n_fields"), F.size(F.col("vocabularies")["flags"]).alias("n_flags"), F.size(F.col("vocabularies")["types"]).alias("n_types"))


@query(
    "file_checksums",
    "S16 S8",
    """WITH f AS (SELECT doc_id // 100 AS stem, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1)
    SELECT 'stem=' || stem AS name, sha256(body) AS sha256, strlen(body)::BIGINT AS bytes, greatest(1, (strlen(body) + 4095) // 4096)::BIGINT AS blocks,
      CASE stem % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'MISMATCH' WHEN 2 THEN 'SIZE MISMATCH' ELSE 'NO ENTRY' END AS status FROM f
    UNION ALL SELECT 'stem=gone', NULL, NULL, NULL, 'MISSING'""",
)
def file_checksums(t: Tables):
    """A file per hundred documents, written, read back in byte ranges and as streams, and held against a manifest with faults."""
    folder = scratch(t)
    stem = F.floor(F.col("doc_id") / 100)
    rows = t.documents.select(stem.alias("stem"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows.repartition("stem").sortWithinPartitions("stem", "doc_id").select("stem", "text").write.partitionBy("stem").text(folder)
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    files = inventory.list_files(t.spark, folder, ["txt"]).select("path", "bytes")
    # the manifest from the table itself; a file holds a hundred documents
    body = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda r: r["text"]), "\n"), F.lit("\n"))
    known = rows.groupBy("stem").agg(body.alias("body")).filter("stem % 4 <> 3")
    sha = F.sha2(F.when(F.col("stem") % 4 == 1, F.concat("body", F.lit("?"))).otherwise(F.col("body")), 256)
    size = F.octet_length("body").cast("long") + F.when(F.col("stem") % 4 == 2, 1).otherwise(0)
    manifest = known.select(F.concat(F.lit("stem="), F.col("stem").cast("string")).alias("name"), sha.alias("sha256"), size.alias("bytes"))
    gone = t.spark.range(1).select(F.lit("stem=gone").alias("name"), F.lit("").alias("sha256"), F.lit(0).cast("long").alias("bytes"))
    have = digests.file_digests(files).select(name.alias("name"), "sha256", "bytes")
    blocks = digests.block_digests(files, 4096).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("blocks"))
    return quality.integrity(have, manifest.unionByName(gone)).join(have, "name", "left").join(blocks, "name", "left")
