"""Registry of runnable queries: a Spark plan, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import tune

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the input tables of one scale folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def activity(self) -> DataFrame:
        """``events`` with the timestamp as epoch microseconds."""
        return self.events.select(
            "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value"
        )


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return self.plan(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers a plan under ``name``; ``covers`` lists the inventory ids it exercises."""

    def add(plan):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, tuple(covers.split()), plan, sql)
        return plan

    return add


# Shared SQL fragment: the activity table as the Spark side sees it.
ACTIVITY = "activity AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type, value FROM events)"
