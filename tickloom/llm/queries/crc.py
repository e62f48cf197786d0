"""CRC-32 in SQL, for databases that lack the function."""

from __future__ import annotations

# A one-row table of the 256 steps of a byte.
CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def crc32(ascii_text: str) -> str:
    """The unsigned CRC-32 of an ASCII string; ``t`` must be in scope."""
    codes = f"list_transform(string_split({ascii_text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"
