"""Operator 13: lines that many documents of ``documents`` share stay in the largest id only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import lines
from tickloom.llm.common import staged
from tickloom.llm.registry import Tables, query

SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    many AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 5),
    m AS (SELECT rid, i, line, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN many USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM m JOIN d USING (rid) GROUP BY rid"""


@query("op13_line_dedup", "op13", SQL)
def op13_line_dedup(t: Tables):
    bitmaps = staged(lines.keep_bitmaps(t.documents), "keep-bitmaps")
    found = lines.apply_bitmaps(t.documents.select("doc_id", "text"), bitmaps)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
