"""Streaming twins run over the event files until everything is processed, then read back.

State, checkpoints and results go to a fresh folder under the shared checkpoint directory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans import alignment, sequences  # noqa: F401  (register the batch twins)
from tickloom.plans.registry import ACTIVITY, QUERIES, Tables, query
from tickloom.session import checkpoint_dir
from tickloom.streaming import stateful

HOUR = 3_600_000_000
DELAY = "1 hour"
CLOSING = "end-of-stream"
NOBODY = -1


def event_stream(t: Tables, home: str) -> DataFrame:
    """The events as a stream, and after them one row of ``NOBODY`` that moves the watermark past all others."""
    events = t.events
    end = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    fixed = {"ts": F.col("ts"), "user_id": F.lit(NOBODY), "event_id": F.lit(NOBODY)}
    closing = end.select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    closing.coalesce(1).write.parquet(f"{home}/closing/{CLOSING}")
    raw = t.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    last = t.spark.readStream.schema(events.schema).parquet(f"{home}/closing/{CLOSING}")
    at = F.col("ts").cast("timestamp")
    return raw.unionByName(last).select("user_id", "event_id", at.alias("at"), F.unix_micros(at).alias("us"), "event_type", "value")


def new_home(t: Tables) -> str:
    stateful.use_rocksdb(t.spark)
    return f"{checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"


def finished(t: Tables, stream: DataFrame, home: str, late: str = "fail") -> DataFrame:
    """What the stream wrote. Rows behind the watermark end it with an error, or are left out with ``late="drop"``."""
    count = stateful.drain(stream, f"{home}/out", f"{home}/state")
    if count and late == "fail":
        raise ValueError(f"{count} rows came after the watermark")
    return t.spark.read.schema(stream.schema).parquet(f"{home}/out").filter(F.col("user_id") != NOBODY)


@query("stream_since_last", "X1", QUERIES["asof_backward_capped"].sql)
def stream_since_last(t: Tables):
    home = new_home(t)
    s = event_stream(t, home).withColumn("is_error", F.coalesce(F.col("event_type") == "error", F.lit(False)))
    out = stateful.since_last(s, "user_id", "at", DELAY, ["us", "event_id"], "is_error", 6 * HOUR)
    return finished(t, out, home).select("event_id", "user_id", "since")


@query("stream_hold_until", "X2", QUERIES["hold_until_reset"].sql)
def stream_hold_until(t: Tables):
    home, kind = new_home(t), F.coalesce("event_type", F.lit(""))
    s = event_stream(t, home).withColumns({"src": kind == "error", "rst": kind.isin("purchase", "signup")})
    out = finished(t, stateful.hold_until(s, "user_id", "at", DELAY, ["us", "event_id"], "src", "rst", "value"), home)
    return out.select("event_id", F.coalesce("held", F.lit(-1.0)).alias("held"))


@query(
    "stream_ingest_once",
    "X3 S6",
    f"""WITH {ACTIVITY} SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id FROM activity) GROUP BY 1, 2""",
)
def stream_ingest_once(t: Tables):
    home = new_home(t)
    s = event_stream(t, home)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = finished(t, stateful.ingest_once(twice, ["event_id"], "at", "60 days"), home)
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_rule_monitor",
    "X4",
    f"""WITH {ACTIVITY} SELECT (us // {24 * HOUR}) * {24 * HOUR} AS start_us, count(*) AS rows, count(*) FILTER (value > 60) AS high, count(*) FILTER (event_type = 'error') AS failed FROM activity GROUP BY 1""",
)
def stream_rule_monitor(t: Tables):
    home = new_home(t)
    rules = {"high": F.col("value") > 60, "failed": F.col("event_type") == "error"}
    events = event_stream(t, home).filter(F.col("user_id") != NOBODY)
    out = stateful.drain_updates(stateful.rule_monitor(events, "at", "1 day", "60 days", rules), ["start"], f"{home}/out", f"{home}/state")
    return out.select(F.unix_micros("start").alias("start_us"), "rows", "high", "failed")


@query("stream_integrate_and_fire", "X5 W21", f"{sequences.FIRE} SELECT user_id, event_id FROM r WHERE level >= 400")
def stream_integrate_and_fire(t: Tables):
    home = new_home(t)
    out = stateful.integrate_and_fire(event_stream(t, home), "user_id", "at", DELAY, ["us", "event_id"], "value", 400.0)
    return finished(t, out, home).filter("fires").select("user_id", "event_id")
