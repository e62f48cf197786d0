"""Operator 12: ``conversations`` are damaged and repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import turns
from tickloom.llm.queries.crc import CRC_TABLE, crc32
from tickloom.llm.registry import Tables, query

# An insertion (5) is never among the cheapest edits: without it, and without one neighbour of it (2), a
# legal conversation stays legal, or becomes legal by one more deletion (2). So the statement needs no insertions,
# and the survivors of a state are told apart by cost and string.
SQL = f"""WITH RECURSIVE {CRC_TABLE},
    o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations, crc_table),
    d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM o)),
    s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c0 FROM s),
    f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault FROM r),
    moves(p, q, c) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
    v AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'edits': '', 'lines': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM d)
        UNION ALL SELECT conv_id, i, q, min(best) FROM (
            SELECT v.conv_id, f.i, v.q, {{'cost': best.cost + 2, 'edits': best.edits || 'D', 'lines': best.lines}} AS best FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1
            UNION ALL SELECT v.conv_id, f.i, m.q, {{'cost': best.cost + CASE WHEN f.c = m.c THEN 0 ELSE 1 END + CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'edits': best.edits || CASE WHEN f.c = m.c THEN 'K' ELSE 'R' END,
                'lines': best.lines || [CASE WHEN f.c = m.c THEN role WHEN m.c = 'u' THEN 'user' ELSE 'assistant' END || ':' || text]}}
                FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1 JOIN moves m ON m.p = v.q WHERE fault NOT IN ('b', 'd') AND (f.c = m.c OR m.c <> 's')) GROUP BY conv_id, i, q),
    n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (c0 IS NOT NULL AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
    e AS (SELECT v.conv_id, min(best) AS best FROM v JOIN n ON v.conv_id IS NOT DISTINCT FROM n.conv_id AND v.i = n.n WHERE q IN (0, 3) GROUP BY v.conv_id)
    SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
        coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.edits, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id"""


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the contract's damage; a null role or text is one space, and so is a null in the key."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    harm = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("harm") == 0, F.array().cast("array<int>")).when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


@query("op12_conversation_repair", "op12", SQL)
def op12_conversation_repair(t: Tables):
    found = turns.repair(damaged(t.conversations))
    rows = found.turns
    counts = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")
    stats = rows.groupBy("conv").agg(gaps, *counts, F.count(F.when(F.col("illegal"), 1)).alias("illegal"))
    all_ids = t.conversations.select("conv_id").distinct().withColumn("conv", turns.conv_key(F.col("conv_id")))
    out = all_ids.join(stats, "conv", "left").join(turns.audits(found.edits), "conv", "left").join(turns.repaired_digests(found), "conv", "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
