"""Folders of many small files: tasks and the driver hold batches of them, not an entry per file."""

from pyspark.sql import functions as F

from tickloom.sources import inventory, local, readers, sinks


def test_small_files_share_tasks(spark, tmp_path):
    """A handful of files per task would be more tasks than this."""
    for i in range(1200):
        (tmp_path / f"d{i}.json").write_text(f'{{"x": {i}}}' if i % 7 else "{")
    files = inventory.list_files(spark, str(tmp_path), ["json"])
    most = 4 * spark.sparkContext.defaultParallelism
    assert files.rdd.getNumPartitions() <= most and local.lines(spark, str(tmp_path), ["json"]).rdd.getNumPartitions() <= most
    good, bad = readers.read_label_files(spark, str(tmp_path), "x int")
    assert len(good.inputFiles()) <= most
    assert files.count() == 1200 and bad.count() == 172
    assert {(r["stem"], r["x"]) for r in good.collect()} == {(f"d{i}", i) for i in range(1200) if i % 7}


def test_files_are_found_as_by_the_readers_of_spark(spark, tmp_path):
    for at in ("a.json", "deep/er/b c%.json", "_hidden.json", ".hid/c.json", "k=1/_k=2/d.json", "é/e.JSON", "é/ü.json", "f.txt", "[g].json", "_h/i.json"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("{}\n x")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "ends.json").write_bytes(b"\xef\xbb\xbfa\r\rb\r\n\n\xef\xbb\xbfc\r")
    (tmp_path / "bad.json").write_bytes(b"\xff{")
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(str(tmp_path))
    want = sorted(tuple(r) for r in text.select(F.col("_metadata.file_path"), "value").collect())
    assert sorted(tuple(r) for r in local.lines(spark, str(tmp_path), ["json"]).collect()) == want and len(want) >= 15
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    for folder in (str(tmp_path), tmp_path.as_uri(), f"file:{tmp_path}"):
        got = inventory.list_files(spark, folder)
        assert {tuple(r) for r in got.select("path", "bytes").collect()} == {(r["path"], r["length"]) for r in binary.select("path", "length").collect()}
        assert got.columns == ["path", "name", "stem", "suffix", "bytes"]


def test_a_document_is_a_file(spark, tmp_path):
    """Repeated, null and empty rows have a file each, and a folder is not written over."""
    rows = [(1, "x"), (1, "x"), (None, None), (None, "a\nb"), (2, "é\"")] + [(i, "y") for i in range(200)]
    folder = str(tmp_path / "out")
    sinks.write_documents(spark.createDataFrame(rows, "n long, s string"), folder)
    files = inventory.list_files(spark, folder, ["json"])
    assert files.count() == files.select("stem").distinct().count() == len(rows)
    good, bad = readers.read_label_files(spark, folder, "n long, s string")
    assert sorted((r["n"], r["s"]) for r in good.filter("n IS NOT NULL").collect()) == sorted(r for r in rows if r[0] is not None)
    assert sorted(r["s"] or "" for r in good.filter("n IS NULL").collect()) == ["", "a\nb"] and bad.isEmpty()
    sinks.write_documents(spark.createDataFrame([], "n long"), str(tmp_path / "none"))
    assert all(t.isEmpty() for t in (inventory.list_files(spark, str(tmp_path / "none")), *readers.read_label_files(spark, str(tmp_path / "none"), "n long")))
    try:
        sinks.write_documents(spark.range(1), folder)
    except FileExistsError:
        return
    raise AssertionError("written over")
