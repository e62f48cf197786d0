"""Many small files in a folder that every machine sees as its own (``file:`` or without a scheme).

Spark's readers hold every file of a folder in the driver and put a handful of small files into a task, and its
writers open, check and move each file alone. Here the driver sees folders only: they are listed by tasks, and files
are read and written in batches. Folders of other stores go through Spark's readers and writers.
"""

from __future__ import annotations

import errno
import fnmatch
import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS, BATCH_BYTES = 4096, 1 << 20  # of one batch of lines
FOUND = "path string, bytes long"


def place(folder: str) -> str | None:
    """The folder as a path of the machine; None in another store, and where a glob stands for folders."""
    if re.search(r"[*?\[{]", folder):
        return None
    if folder.startswith("file:"):
        inner = re.sub(r"^file:(//)?", "", folder)
        return inner if inner.startswith("/") else None
    return folder if folder.startswith("/") else None


def uri(path: str) -> str:
    """A path as Spark names it in ``_metadata.file_path``."""
    return re.sub(r'[\s"#%<>?\[\\\]^`{|}]', lambda m: quote(m[0]), f"file:{path}")


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _walk(folder: str, deep: bool, suffixes: Sequence[str]) -> Iterator[tuple[str, int]]:
    waiting = [folder]
    while waiting:
        with os.scandir(waiting.pop()) as found:
            for e in found:
                if _hidden(e.name):
                    continue
                if e.is_dir():
                    if deep:
                        waiting.append(e.path)
                elif not suffixes or any(fnmatch.fnmatchcase(e.name, f"*.{s}") for s in suffixes):
                    if size := e.stat().st_size:
                        yield e.path, size


def _lister(suffixes: Sequence[str]):
    def batch(rows: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int]] = []
        for asked in batches:
            for folder in asked.to_pylist():
                for row in _walk(folder["folder"], folder["deep"], suffixes):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def listed(spark: SparkSession, folder: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """``path, bytes`` of the files at any depth below the folder; hidden and empty ones are left out, as Spark's readers do."""
    with os.scandir(folder) as found:
        below = [e.path for e in found if not _hidden(e.name) and e.is_dir()]
    asked = spark.createDataFrame([(folder, False), *((b, True) for b in sorted(below))], "folder string, deep boolean")
    return asked.repartition(min(len(below) + 1, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_lister(tuple(suffixes)), FOUND)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, values, held = [], [], 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            name, first = uri(path), True
            with open(path, "rb") as f:
                for raw in f:
                    raw, first = raw.removeprefix(b"\xef\xbb\xbf") if first else raw, False
                    for line in raw.splitlines():
                        paths.append(name)
                        values.append(line.decode("utf-8", "replace"))
                        held += len(line)
                        if len(paths) == BATCH_ROWS or held > BATCH_BYTES:
                            yield _named(paths, values)
                            paths, values, held = [], [], 0
    if paths:
        yield _named(paths, values)


def _named(paths: list[str], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], names=["path", "value"])


def lines(spark: SparkSession, folder: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """``path, value`` of the lines of all files below the folder, dealt to all cores by file."""
    files = listed(spark, folder, suffixes).select("path")
    return files.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_lines, "path string, value string")


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, n = f"{folder}/.{uuid.uuid4().hex}", 0
        for batch in batches:
            if not n and batch.num_rows:
                os.mkdir(own)
            for text in batch.column("value").to_pylist():
                with open(f"{own}/part-{part:05d}-{n:08d}.json", "w", encoding="utf-8", newline="") as f:
                    f.write(text + "\n")
                n += 1
        if n:
            try:
                os.rename(own, f"{folder}/part-{part:05d}")
            except OSError as e:  # another attempt of this task was first
                if e.errno not in (errno.ENOTEMPTY, errno.EEXIST):
                    raise
                shutil.rmtree(own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def write_texts(rows: DataFrame, folder: str) -> int:
    """A file per row with its ``value`` as a line, below a new folder; a task's files show up together."""
    os.makedirs(folder)
    written = rows.select("value").mapInArrow(_writer(folder), "n long").groupBy().sum("n").first()[0] or 0
    open(f"{folder}/_SUCCESS", "w").close()
    return written
