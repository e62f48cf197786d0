"""Operator 11: a Merkle manifest of ``documents`` with one tree per language, its proofs, and a check of a tampered copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import merkle
from tickloom.llm.common import ascii_lower, scratch
from tickloom.llm.queries.crc import CRC_TABLE, crc32
from tickloom.llm.registry import Tables, query

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
SQL = f"""WITH RECURSIVE {CRC_TABLE},
    d AS (SELECT row_number() OVER () AS rid, doc_id, lang, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
        sha256({_HEAD} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lowered,
        {crc32("doc_id::VARCHAR")} AS crc FROM documents, crc_table),
    num AS (SELECT *, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS probe, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
    tree(lang, lv, i, n, h) AS (SELECT lang, 0, i, n, leaf FROM num
        UNION ALL SELECT lang, lv + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, lv, i // 8),
    sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
    top(lv, i, n, h) AS (SELECT 0, i, n, subroot FROM sub UNION ALL SELECT lv + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // 8),
    walk(rid, lang, lv, i, n, h, sibs) AS (SELECT rid, lang, 0, i, n, probe, '' FROM num
        UNION ALL SELECT w.rid, any_value(w.lang), any_value(w.lv) + 1, any_value(w.i) // 8, (any_value(w.n) + 7) // 8, sha256(string_agg(CASE WHEN t.i = w.i THEN w.h ELSE t.h END, '' ORDER BY t.i)),
            any_value(w.sibs) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> w.i), '')
            FROM walk w JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lv = w.lv AND t.i // 8 = w.i // 8 WHERE w.n > 1 GROUP BY w.rid),
    climb(rid, lv, i, n, h, sibs) AS (SELECT rid, 0, sub.i, sub.n, walk.h, sibs FROM walk JOIN sub ON walk.lang IS NOT DISTINCT FROM sub.lang WHERE walk.n = 1
        UNION ALL SELECT w.rid, any_value(w.lv) + 1, any_value(w.i) // 8, (any_value(w.n) + 7) // 8, sha256(string_agg(CASE WHEN t.i = w.i THEN w.h ELSE t.h END, '' ORDER BY t.i)),
            any_value(w.sibs) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> w.i), '')
            FROM climb w JOIN top t ON t.lv = w.lv AND t.i // 8 = w.i // 8 WHERE w.n > 1 GROUP BY w.rid)
    SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(sibs) AS proof_sha256, climb.h AS folded_root, climb.h = (SELECT h FROM top WHERE n = 1) AS verified
    FROM num JOIN climb USING (rid) JOIN sub ON num.lang IS NOT DISTINCT FROM sub.lang WHERE climb.n = 1"""


def leaf_of(text):
    return merkle.record_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


@query("op11_merkle_manifest", "op11", SQL)
def op11_merkle_manifest(t: Tables):
    """A null ``doc_id`` is not tampered with; rows of one id are ordered by their leaf."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = leaf_of(F.col("text"))
    rows = t.documents.select("doc_id", merkle.tree_key(F.col("lang")).alias("tree"), leaf.alias("digest"), F.when(tampered, leaf_of(ascii_lower(F.col("text")))).alias("tampered"))
    trees, top = merkle.manifest(rows, scratch(t.spark, "merkle"), ["doc_id"])
    found = merkle.proofs(trees, top).withColumn("folded_root", merkle.folded(F.coalesce("tampered", "digest"), F.col("siblings")))
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(merkle.proof_text(F.col("siblings")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
