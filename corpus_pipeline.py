"""A training corpus from raw documents: language, near duplicates, benchmark leaks, packed sequences.

Each stage takes the documents its predecessor kept, drops what it rejects, and returns the
columns of ``documents``; the last returns the packed pieces. Stages meet in Parquet tables in
the shared folder, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontam, jaccard, langid, packing
from tickloom.llm.common import staged, without
from tickloom.session import tune


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no recognisable language: without letters, or with all languages about equally likely.

    Without labelled rows no language is known, and only documents without letters go.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = langid.predict(docs, model)
    nothing = F.lit(1.5 / max(len(model.languages), 2))
    rejected = (F.col("lang_pred") == langid.UNKNOWN) | (F.col("ambiguous") & (F.col("score") < nothing))
    return found.filter(~rejected).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the Jaccard join (five words, 0.8)."""
    gone, again = jaccard.duplicates(docs, k=5, num=80, den=100)
    kept = without(docs, gone)
    again = staged(again, "again")
    if again.isEmpty():
        return kept
    once = kept.join(again.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__hash")))
    once = once.dropDuplicates(["__id", "__hash"]).drop("__id", "__hash")
    return without(kept, again).unionByName(once)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words, or a whole shorter item, of the benchmark."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.filter("contaminated").select("doc_id", "text_hash"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, chunk_bytes=1 << 19)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", leaks), ("packing", sequences)]

# Language scores and tokenizer ids can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
