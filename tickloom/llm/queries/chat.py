"""Operator 10: every conversation from every participant's perspective."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import chat
from tickloom.llm.registry import Tables, query

SQL = """WITH c AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
    p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), content) - 1) // 256 AS part FROM c),
    s AS (SELECT DISTINCT conv_id AS of, role AS speaker FROM c WHERE role <> 'system'),
    m AS (SELECT p.*, speaker, CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>'
        ELSE '<|user name=' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' END || chr(10) AS head FROM p JOIN s ON conv_id IS NOT DISTINCT FROM of),
    n AS (SELECT *, row_number() OVER w AS k, coalesce(sum(length(head) + length(content) + 8) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins
        FROM m WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, coalesce(role, ''), content))
    SELECT conv_id, speaker, part::BIGINT AS part, count(*)::INTEGER AS n_turns, count(*) FILTER (role = speaker)::INTEGER AS n_own,
        string_agg(head || content || '<|end|>' || chr(10), '' ORDER BY k) AS text,
        coalesce(string_agg(begins::BIGINT || '-' || (begins + length(content))::BIGINT, ' ' ORDER BY k) FILTER (role = speaker), '') AS spans
    FROM n GROUP BY conv_id, speaker, part"""


@query("op10_perspective_rotation", "op10", SQL)
def op10_perspective_rotation(t: Tables):
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), " ")
    return chat.rotate(t.conversations).withColumn("spans", spans)
