"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows.

``python tests/oracle.py [--sf 0.01] [--limit N] [name …]``; ``--limit`` sets the rows
one task may sort, so a small value forces the hot-key paths.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tickloom.plans import load_queries  # noqa: E402
from tickloom.plans.registry import TABLES  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def nearly_equal(got, want, tolerance: float) -> bool:
    """Whether rows agree when floats may differ by a rounding step."""

    def grouped(rows):
        out = {}
        for r in rows:
            key = tuple(v for v in r if not isinstance(v, float))
            out.setdefault(key, []).append(tuple(v for v in r if isinstance(v, float)))
        return {k: sorted(v) for k, v in out.items()}

    a, b = grouped(got), grouped(want)
    return a.keys() == b.keys() and all(
        len(a[k]) == len(b[k]) and all(len(x) == len(y) and all(math.isclose(p, q, abs_tol=tolerance) for p, q in zip(x, y)) for x, y in zip(a[k], b[k])) for k in a
    )


def compare(columns, rows, want_columns, want_rows, tolerance: float = 0.0) -> str:
    """'' when both results hold the same rows, else the first difference."""
    if sorted(columns) != sorted(want_columns):
        return f"columns {sorted(columns)} != {sorted(want_columns)}"
    if len(rows) != len(want_rows):
        return f"rows {len(rows)} != {len(want_rows)}"
    names = sorted(columns)
    here, there = [columns.index(c) for c in names], [want_columns.index(c) for c in names]
    got = [tuple(plain(r[i]) for i in here) for r in rows]
    want = [tuple(plain(r[i]) for i in there) for r in want_rows]
    for i, name in enumerate(names):
        kinds = {type(r[i]) for r in got if r[i] is not None} , {type(r[i]) for r in want if r[i] is not None}
        if kinds[0] and kinds[1] and kinds[0] != kinds[1]:
            return f"column {name}: types {kinds[0]} != {kinds[1]}"
    extra, missing = Counter(got) - Counter(want), Counter(want) - Counter(got)
    if not extra and not missing:
        return ""
    if tolerance and nearly_equal(extra.elements(), missing.elements(), tolerance):
        return ""
    first = sorted(extra, key=repr)[:2], sorted(missing, key=repr)[:2]
    return f"{sum(extra.values())} of {len(got)} rows differ: got {first[0]} want {first[1]} ({names})"


def check(spark, con, folder: str, q, tolerance: float = 0.0) -> tuple[str, int, float]:
    start = time.time()
    df = q(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if q.sql is None:
        return "", len(rows), took
    res = con.execute(q.sql)
    want_columns = [d[0] for d in res.description]
    return compare(df.columns, rows, want_columns, res.fetchall(), tolerance), len(rows), took


def main(argv: list[str]) -> int:
    from tickloom.session import GROUP_LIMIT_KEY, build_session

    sf, limit, names = "0.01", None, []
    args = list(argv)
    while args:
        a = args.pop(0)
        if a == "--sf":
            sf = args.pop(0)
        elif a == "--limit":
            limit = args.pop(0)
        else:
            names.append(a)
    spark = build_session("oracle", "local[8]", 8)
    if limit:
        spark.conf.set(GROUP_LIMIT_KEY, limit)
    folder = f"/root/testdata/sf{sf}"
    con, bad = duck(folder), 0
    queries = load_queries()
    chosen = [n for n in queries if not names or any(n == x or n.startswith(x) for x in names)]
    for n in chosen:
        try:
            problem, count, took = check(spark, con, folder, queries[n])
        except Exception as e:  # noqa: BLE001
            problem, count, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {n:34s} rows={count:<8d} {took:6.2f}s {'' if queries[n].sql else '(rows only)'} {problem[:900]}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
