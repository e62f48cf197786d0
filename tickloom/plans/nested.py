"""Nested JSON states of any depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import trees
from tickloom.plans.registry import Tables, query


@query(
    "redacted_states",
    "P31",
    """WITH e AS (SELECT event_id, event_type, user_id, json_extract(props, '$.k') AS k, (event_id % 4)::INT AS deep FROM events)
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'none' ELSE
      repeat('{"w": [', deep) || '{"alpha": "q\\"' || user_id || '", "zone": {"k": ' || k || ', "list": [' || k || ', {"a": null, "b": "' || event_type || '"}, []]}}' || repeat(']}', deep) END AS canonical FROM e""",
)
def redacted_states(t: Tables):
    """States around each event's properties, nested to different depths; errors leave theirs unfinished."""
    k = F.get_json_object("props", "$.k")
    state = F.concat(
        F.lit('{"zone":{"score":1,"list":['), k, F.lit(',{"tick":5,"b":"'), "event_type", F.lit('","a":null},[]],"k":'), k, F.lit('},"player":{"name":["x"]},"alpha":"q\\"'), F.col("user_id").cast("string"), F.lit('"'),
        F.when(F.col("event_type") == "error", "").otherwise("}"),
    )
    deep = (F.col("event_id") % 4).cast("int")
    rows = t.events.select("event_id", F.concat(F.repeat(F.lit('{"time":{},"w":['), deep), state, F.repeat(F.lit("]}"), deep)).alias("state"))
    return trees.canonical_texts(rows, "state").select("event_id", F.coalesce("canonical", F.lit("none")).alias("canonical"))
