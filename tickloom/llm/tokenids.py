"""Token ids as flat binary files with 64-bit document offsets.

A dataset is a folder. Each partition of the documents, in ascending order of id, writes

* ``part-NNNNN.ids``     the ids of its documents one after another, unsigned little-endian,
  two bytes each where the vocabulary allows it, else four;
* ``part-NNNNN.starts``  n + 1 unsigned 64-bit offsets into that file, in ids;
* ``part-NNNNN.docs``    n signed 64-bit document ids (the first ``n_null`` ones stand for null).

``manifest`` (Parquet) has a row per partition with its counts and, from prefix sums over
them, ``token_base`` and ``doc_base``: what all partitions before it hold. Readers map the files
into memory where the storage is mounted.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import tidy
from tickloom.llm.encode import WordEncoder, chunks

MANIFEST = "part int, n_docs long, n_null long, n_tokens long"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _publish(fs: pafs.FileSystem, folder: str, name: str, temporary: str) -> None:
    """A finished file gets its name in one step, so that a task tried again can't leave half a file."""
    fs.move(f"{folder}/{temporary}", f"{folder}/{name}")


def _writer(path: str, tokenizer: str, spaced: bool, end_id: int, width: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer, spaced)
        fs, folder = _place(path)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        stream, starts, docs, n_null, total = None, [np.zeros(1, np.uint64)], [], 0, 0
        for batch in batches:
            for some in chunks(batch):
                if stream is None:
                    stream = fs.open_output_stream(f"{folder}/.{attempt}.ids")
                ids, begins = encoder.encode(some.column("text"))
                ends = begins[1:] + np.arange(1, some.num_rows + 1)  # with an end id after each document
                out = np.full(len(ids) + some.num_rows, end_id, dtype=width)
                body = np.ones(len(out), dtype=bool)
                body[ends - 1] = False
                out[body] = ids
                stream.write(out.tobytes())
                starts.append((total + ends).astype(np.uint64))
                total += len(out)
                n_null += some.column("doc_id").null_count
                docs.append(some.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        if stream is None:
            return
        stream.close()
        _publish(fs, folder, f"part-{part:05d}.ids", f".{attempt}.ids")
        for name, blocks in (("starts", starts), ("docs", docs)):
            with fs.open_output_stream(f"{folder}/.{attempt}.{name}") as f:
                for b in blocks:
                    f.write(b.tobytes())
            _publish(fs, folder, f"part-{part:05d}.{name}", f".{attempt}.{name}")
        n = sum(map(len, docs))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (n, n_null, total))], names=["part", "n_docs", "n_null", "n_tokens"])

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaced: bool = True, vocabulary: int = 50_257) -> DataFrame:
    """Encodes ``doc_id, text`` into a dataset at ``path`` and returns its manifest.

    Rows are written in ascending ``doc_id`` (null first), repeated ids in the order of a hash of
    their text; range partitioning by both keeps a repeated id from filling one task. A null
    text counts as empty and still gets its end id. Other columns are not read. An empty table
    gives a dataset without parts. ``path`` must be shared by all executors.
    """
    spark = docs.sparkSession
    fs, folder = _place(path)
    fs.create_dir(folder, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    width = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    parts = rows.mapInArrow(tidy("encode", _writer(path, tokenizer, spaced, end_id, width)), MANIFEST)
    parts.write.parquet(f"{path}/parts")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/parts")
    bases = [F.coalesce(F.sum(f"n_{what}s").over(before), F.lit(0)).cast("long").alias(f"{what}_base") for what in ("token", "doc")]
    manifest.select("*", *bases, F.lit(width).alias("width")).coalesce(1).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, token_base long, doc_base long, width string").parquet(f"{path}/manifest")


def mapped(path: str, name: str, dtype: str) -> np.ndarray:
    """A file of the dataset as an array: mapped into memory on mounted storage, else read."""
    fs, folder = _place(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{folder}/{name}", dtype=dtype, mode="r")
    with fs.open_input_file(f"{folder}/{name}") as f:
        return np.frombuffer(f.read(), dtype=dtype)


def _reader(path: str, with_ids: bool, block: int = 4096):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            name = f"part-{row['part']:05d}"
            ids, starts = mapped(path, f"{name}.ids", row["width"]), mapped(path, f"{name}.starts", "<u8").astype(np.int64)
            docs = mapped(path, f"{name}.docs", "<i8")
            for a in range(0, row["n_docs"], block):
                b = min(a + block, row["n_docs"])
                wide = [ids[starts[i] : starts[i + 1]].astype("<u4").tobytes() for i in range(a, b)]
                columns = [
                    pa.array(docs[a:b], mask=np.arange(a, b) < row["n_null"]),
                    pa.array(row["token_base"] + starts[a:b]),
                    pa.array(np.diff(starts[a : b + 1])),
                    pa.array(wide, pa.binary()) if with_ids else pa.array([zlib.crc32(x) for x in wide], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])

    return read


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a dataset: ``doc_id, start, n_tokens`` and their ids (little-endian unsigned
    32-bit) or, without them, the ids' CRC-32. ``start`` counts the ids of all documents before."""
    manifest = read_manifest(spark, path)
    parts = max(1, manifest.count())
    last = "ids binary" if with_ids else "ids_crc32 long"
    return manifest.repartition(parts).mapInArrow(_reader(path, with_ids), f"doc_id long, start long, n_tokens long, {last}")
