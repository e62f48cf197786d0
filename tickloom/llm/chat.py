"""Chat formatting by perspective rotation: every participant in turn is the assistant.

For each participant of a conversation the whole dialogue is rendered once: that speaker's turns
as the assistant's, everybody else's as named users', system turns as they are. The mask gives
the characters of the speaker's own words, which are what a model is trained on.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import let_array
from tickloom.llm.ranks import ranked

SYSTEM = "system"


def _safe(c: Column) -> Column:
    """Content can't hold a template sign: ``<|`` becomes ``< |``."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = 256) -> DataFrame:
    """One row per conversation, participant and part: ``conv_id, speaker, part, n_turns, n_own, text, spans``.

    A participant is a role that isn't ``system``. Messages read
    ``<|assistant|>``, ``<|system|>`` or ``<|user name=ROLE|>``, a line break, the content, ``<|end|>`` and a
    line break; ``<|`` in contents and names becomes ``< |``. ``spans`` are the speaker's contents as
    ``struct(start, stop)`` in characters of the part's text.

    Turns are ordered by number (null first), role and text. A part holds ``part_turns`` consecutive
    turns, whatever their numbers, so that a conversation of any length is never gathered in one row;
    its parts, in order, are the whole dialogue. Repeated turns stay. A null role speaks as the user ``unknown`` and is no participant; a null
    text is empty; a null conversation id is a conversation of its own. A conversation of system
    turns only, or an empty table, gives no rows. Other columns are not read.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), _safe(F.col(text)).alias("content")
    )
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = ranked(rows.select("*", key.alias("conv"), F.coalesce("role", F.lit("")).alias("order_role")), "conv", ["turn", "order_role", "content"], "dialogue")
    part = F.floor(F.col("idx") / part_turns).cast("long")
    turn_of = F.struct("idx", "content", "role")
    parts = rows.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(turn_of)).alias("turns"))
    speakers = rows.filter(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))

    def head(m: Column) -> Column:
        user = F.concat(F.lit("<|user name="), _safe(F.coalesce(m["role"], F.lit("unknown"))), F.lit("|>\n"))
        own = m["role"].eqNullSafe(F.col("speaker"))
        return F.when(m["role"].eqNullSafe(F.lit(SYSTEM)), "<|system|>\n").when(own, "<|assistant|>\n").otherwise(user)

    def span(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(head(m))
        stop = start + F.length(m["content"])
        mine = F.when(m["role"].eqNullSafe(F.col("speaker")), F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
        return F.struct((stop + len("<|end|>\n")).alias("at"), F.concat(acc["spans"], mine).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    text_of = F.array_join(F.transform("turns", lambda m: F.concat(head(m), m["content"], F.lit("<|end|>\n"))), "")
    return views.select(
        "conv_id", "speaker", "part", F.size("turns").alias("n_turns"),
        F.size(F.filter("turns", lambda m: m["role"].eqNullSafe(F.col("speaker")))).alias("n_own"), text_of.alias("text"),
        let_array(F.col("turns"), lambda t: F.aggregate(t, zero, span, lambda acc: acc["spans"])).alias("spans"),
    )


