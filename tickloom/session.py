"""Session defaults and the few settings the package reads.

``tickloom.groupLimit``   rows of one key that a single task may sort; keys with
                          more rows are split by order range (see ``ordered``).
``spark.checkpoint.dir``  shared folder for cut lineage, set by the cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

GROUP_LIMIT_KEY = "tickloom.groupLimit"
DEFAULT_GROUP_LIMIT = 1_000_000
CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tickloom", master: str | None = None, shuffle: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the package is tuned for.

    ``master`` is only for local runs; on a cluster the submit command sets it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    spark = builder.config(map=extra or {}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Runtime settings the queries rely on, also for a session somebody else built.

    UTC makes timestamps read alike everywhere. Stages with very many expressions would
    compile into methods the JVM refuses to optimise; above 8000 bytes of bytecode the
    expressions are compiled in pieces instead. Arrow batches are bounded by bytes, because ten
    thousand long texts would be a batch of any size.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def group_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_LIMIT_KEY, str(DEFAULT_GROUP_LIMIT)))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, else a folder in the warehouse."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tickloom-scratch"


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared storage, deleted when the driver ends in good order."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once into a scratch folder and read back, for results that several plans read."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder (survives executor loss)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()
