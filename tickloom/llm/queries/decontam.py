"""Operator 9: ``documents`` against the windows of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import decontam
from tickloom.llm.registry import Tables, query

# Every window of 10 words, or a whole shorter item, joined on its words; then the words the occurrences cover.
SQL = r"""WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bs AS (SELECT item_id, w, least(len(w), 10) AS m FROM bw WHERE len(w) > 0),
    wins AS (SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS span FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM bs)),
    sizes AS (SELECT DISTINCT m FROM wins),
    seq AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM dw),
    tens AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM seq),
    occ AS (SELECT doc_id, m, i, list_slice(ten, 1, m) AS span FROM tens, sizes WHERE len(ten) >= m),
    hit AS MATERIALIZED (SELECT o.doc_id, o.i, o.m, b.item_id FROM occ o JOIN wins b ON o.m = b.m AND o.span = b.span),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
    items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list FROM hit GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op9_winnowing_decontamination", "op9", SQL)
def op9_winnowing_decontamination(t: Tables):
    found = decontam.contamination(t.documents, t.benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
