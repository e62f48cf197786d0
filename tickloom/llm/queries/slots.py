"""Operator 8: sharding of ``documents`` through virtual slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import slots
from tickloom.llm.common import scratch
from tickloom.llm.registry import Tables, query

SHARDS = 40


@query("op8_slot_sharding", "op8")
def op8_slot_sharding(t: Tables):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    docs = t.documents.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    placed = slots.shard_records(docs, SHARDS, scratch(t.spark, "slot-map"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
    )
