"""Merkle manifests, conversation repair and line deduplication against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import lines, merkle, turns
from tickloom.llm.common import scratch
from tickloom.llm.ranks import ranked


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- ranks


def test_ranks_of_a_group_that_spans_many_tasks(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = defaultdict(list)
    for r in ranked(rows, "g", ["x"], "ranks").collect():
        assert r["size"] == (1000 if r["g"] == "a" else 2000)
        got[r["g"]].append((r["idx"], r["x"]))
    for g, found in got.items():
        assert [i for i, _ in sorted(found)] == list(range(len(found)))
        assert [x for _, x in sorted(found)] == sorted(x for _, x in found)
    same = spark.range(500).select(F.lit("a").alias("g"), F.lit(1).alias("x"))
    assert sorted(r["idx"] for r in ranked(same, "g", ["x"], "ranks").collect()) == list(range(500))


# ---- 11: Merkle manifest


def brute_tree(leaves, fan):
    """Root, and the siblings of every leaf level by level."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // fan * fan
            ways[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fan])))
        nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        at = [i // fan for i in at]
    return nodes[0], ways


def brute_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.mark.parametrize(("fan", "stride"), [(8, 3), (2, 1), (3, 2)])
def test_manifest(spark, fan, stride):
    rng = random.Random(5)
    rows = [(i, rng.choice(["en"] * 6 + ["é", None, "", "z"]), "tx" * rng.randint(0, 3) if rng.random() < 0.9 else None, 1) for i in range(150)]
    rows += [(None, "en", "no id", 1), (None, None, None, 1), (7, "en", "again", 1), (7, "en", "again", 1), (999, "alone", "long " * 40_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, idx int").repartition(5)
    digest = merkle.record_digest(F.col("doc_id"), F.col("lang"), F.col("text"))
    leaves = docs.select("doc_id", "text", "idx", merkle.tree_key(F.col("lang")).alias("tree"), digest.alias("digest"))
    trees, top = merkle.manifest(leaves, scratch(spark, "manifest"), ["doc_id"], fan, stride)
    got = merkle.proofs(trees, top).withColumn("folded", merkle.folded(F.col("digest"), F.col("siblings"))).collect()
    assert len(got) == len(rows)

    groups = defaultdict(list)
    for i, lang, text, _ in rows:
        groups[lang].append(((i is not None, i or 0), sha(brute_field(i) + brute_field(lang) + brute_field(text))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: brute_tree([h for _, h in sorted(groups[g])], fan) for g in order}
    root, over = brute_tree([subs[g][0] for g in order], fan)
    want = []
    for g, above in zip(order, over):
        for (key, h), way in zip(sorted(groups[g]), subs[g][1]):
            want.append((key[1] if key[0] else None, h, subs[g][0], root, [*way, *above]))
    have = [(r["doc_id"], r["digest"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["siblings"]]) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert all(r["folded"] == root for r in got)


def test_a_tampered_leaf_misses_the_root(spark):
    rows = spark.range(100).select(F.lit("t").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    found = merkle.proofs(*merkle.manifest(rows, scratch(spark, "manifest"), ["id"]))
    wrong = found.withColumn("folded", merkle.folded(F.sha2(F.concat(F.col("digest"), F.lit("x")), 256), F.col("siblings")))
    assert wrong.filter(F.col("folded") == F.col("root")).count() == 0


def test_only_stored_levels_are_written(spark):
    rows = spark.range(1000).select(F.lit("t").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    forest = merkle.store_forest(rows, scratch(spark, "forest"), ["id"], 8, 2)
    assert [forest.level(k).count() for k in range(forest.levels + 1)] == [1000, 16, 1]


def test_empty_manifest(spark):
    rows = spark.range(0).select(F.lit("t").alias("tree"), "id", F.lit("").alias("digest"))
    assert merkle.proofs(*merkle.manifest(rows, scratch(spark, "manifest"), ["id"])).count() == 0


# ---- 12: conversation repair


def brute_edits(rows, costs):
    """Cheapest cost and least string by looking at whole endings: rows are ``(initial, lost, truncated)``."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, ""), "a": (0, ""), "u": (costs.insert, "I"), "s": (2 * costs.insert, "II")}  # by the state at the end
    for initial, lost, truncated in reversed(rows):
        new = {}
        for state in ("", "s", "u", "a"):
            found = []
            for added in ("", "u", "a", "ua", "au"):
                at, cost = state, costs.insert * len(added)
                for x in added:
                    at = legal.get((at, x)) if at is not None else None
                if at is None:
                    continue
                found.append((cost + costs.delete + best[at][0], "I" * len(added) + "D" + best[at][1]))
                if lost:
                    continue
                for to, letter, price in [(initial, "K", 0), ("u", "R", costs.rerole), ("a", "R", costs.rerole)]:
                    if (after := legal.get((at, to))) is not None and to in ("s", "u", "a"):
                        found.append((cost + price + (costs.truncated if truncated else 0) + best[after][0], "I" * len(added) + letter + best[after][1]))
            new[state] = min(found)
        best = new
    return best[""]


@pytest.mark.parametrize("costs", [turns.Costs(), turns.Costs(1, 2, 1, 5), turns.Costs(1, 3, 2, 1)])
def test_search_equals_brute_force(costs):
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice("suauax?"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(0, 9))]
        options = [turns.row_options(i if i in "sua" else "?", lost, cut, costs) for i, lost, cut in rows]
        edits = turns.solved(options, costs)
        text = "".join(letter for _, letter, _ in edits)
        state = edits[-1][2] if edits else turns.NOTHING
        text += {turns.SYSTEM: "II", turns.USER: "I"}.get(state, "")
        price = {"D": costs.delete, "I": costs.insert, "K": 0, "R": costs.rerole}
        total = sum(price[x] for x in text) + sum(costs.truncated for u, x, _ in edits if x in "KR" and rows[u][2])
        assert (total, text) == brute_edits(rows, costs), rows


def test_edits_leave_the_tree_as_soon_as_survivors_meet():
    costs, sure = turns.Costs(), []
    walk = turns.Survivors(turns.NOTHING, costs, lambda *e: sure.append(e))
    most = 0
    for i in range(2000):
        walk.step(turns.row_options("ua"[i % 2], False, False, costs))
        most = max(most, i + 1 - len(sure))
    assert most < 10
    walk.finish(turns.ASSISTANT)
    assert "".join(x for _, x, _ in sure) == "K" * 2000


def brute_faults(rows):
    """Faults, illegal pairs and units of one conversation's rows ``(turn, role, text)`` in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        seen_before = (role, text) in seen
        seen.add((role, text))
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if seen_before else "truncated" if solid[-1] not in ".!?" else None)
    illegal = [i > 0 and rows[i - 1][1][:1] + rows[i][1][:1] not in ("su", "ua", "au") for i in range(len(rows))]
    return faults, illegal


@pytest.mark.parametrize("part_rows", [2, 5, 1024])
def test_repair(spark, part_rows):
    rng = random.Random(part_rows)
    texts = ["Hello.", "What?", "so", " \t", "", None, "Yes!\n", "tail ", "ok. \x0b", "long " * 30_000 + "."]
    table = [(c, rng.choice([None, *range(30)]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None, "", "sys"]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randint(0, 50)}.") for c in (1, 2, 3, None) for _ in range(rng.randint(1, 40))]
    table += [(4, i, "ua"[i % 2], f"{i}.") for i in range(64)] + [(5, 0, "user", "x.")] * 9 + [(6, i, "user", f"{i}.") for i in range(33)]
    frame = spark.createDataFrame([(*r, "y", 0) for r in table], "conv_id long, turn long, role string, text string, conv string, size int").repartition(3)
    found = turns.repair(frame, part_rows=part_rows)
    audits = {r["conv"]: (r["audit"], r["cost"]) for r in turns.audits(found.edits, part_rows).collect()}
    digests = {r["conv"]: r["repaired_sha256"] for r in turns.repaired_digests(found).collect()}
    rows, repaired = defaultdict(list), defaultdict(list)
    for r in found.turns.orderBy("idx").collect():
        rows[r["conv"]].append((r["turn"], r["role"], r["text"], r["fault"], r["illegal"]))
    for r in turns.repaired_turns(found).orderBy("idx", "seq").collect():
        repaired[r["conv"]].append(f"{r['role']}:{r['text']}")
    want = defaultdict(list)
    for c, turn, role, text in table:
        want["" if c is None else f"={c}"].append((turn, " " if role is None else role, " " if text is None else text))
    assert rows.keys() == want.keys() == audits.keys() == digests.keys()
    for conv, mine in want.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, illegal = brute_faults(mine)
        assert rows[conv] == [(*r, f, i) for r, f, i in zip(mine, faults, illegal)]
        cost, audit = brute_edits([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(mine, faults)], turns.Costs())
        assert audits[conv] == (audit, cost)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in repaired[conv]))
        assert digests[conv] == sha("\n".join(repaired[conv]))
        left = [(r[1], r[2]) for r, letter in zip(mine, audit) if letter != "D"]
        assert [t for _, t in left] == [x.split(":", 1)[1] for x in repaired[conv]]


def test_repair_with_inserted_turns(spark):
    costs = turns.Costs(1, 2, 1, 5)
    table = [(c, i, role, f"{c} {i}.") for c, roles in enumerate(["uuaa", "sa", "u", "s", "auau" * 5]) for i, role in enumerate(roles)]
    found = turns.repair(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"), costs=costs, part_rows=3)
    got = {r["conv"]: (r["cost"], r["audit"]) for r in turns.audits(found.edits, 3).collect()}
    for c, roles in enumerate(["uuaa", "sa", "u", "s", "auau" * 5]):
        assert got[f"={c}"] == brute_edits([(r, False, False) for r in roles], costs)
    repaired = defaultdict(str)
    for r in turns.repaired_turns(found).orderBy("idx", "seq").collect():
        repaired[r["conv"]] += r["role"][0]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in repaired.values())
    assert {r["conv"] for r in turns.repaired_digests(found).collect()} == {f"={c}" for c in range(5)}


def test_repair_of_nothing(spark):
    found = turns.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert found.edits.count() == 0 and turns.audits(found.edits).count() == 0 and turns.repaired_digests(found).count() == 0


# ---- 13: lines


def brute_lines(rows, min_chars, min_docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(" \t\n\x0b\x0c\r").translate(low)].add((i is not None, i or 0))
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").translate(low) for x in parts]
        kept = [x for x, k in zip(parts, keys) if len(k) < min_chars or len(holders[k]) < min_docs or max(holders[k]) == (i is not None, i or 0)]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("min_chars", "min_docs", "ranges"), [(4, 3, 1), (4, 3, 40), (1, 2, 8), (4, 5, 300)])
def test_line_dedup(spark, min_chars, min_docs, ranges):
    rng = random.Random(min_docs)
    pool = [f"line {k} É " for k in range(12)] + ["the hot line of all", "THE HOT LINE OF ALL\r", "  the hot line of all\t", "", "abc", " abc", "abcd", "\x0babcd\x0c", "ÉCOLE", "école"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(i + 100, "the hot line of all") for i in range(200)] + [(None, "the hot line of all\nabcd"), (None, None), (None, "abcd"), (5, "abcd\nabcd\nabcd"), (5, ""), (7, "line 1 É \n" * 30_000)] + [(8, "abcd\nline 2 É ")] * 20
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h1 int, pos int").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bitmaps = lines.keep_bitmaps(docs, min_chars=min_chars, min_docs=min_docs)
        got = [tuple(r) for r in lines.apply_bitmaps(docs, bitmaps).collect()]
        assert sorted(got, key=repr) == brute_lines(rows, min_chars, min_docs)
        for r in bitmaps.collect():
            assert lines.unpack_bitmap(bytes(r["keep"]), r["n_lines"]).sum() == r["n_lines"] - r["n_dropped"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.apply_bitmaps(docs, lines.keep_bitmaps(docs)).count() == 0


def test_bitmaps_round_trip():
    for n, gone in itertools.product((1, 7, 8, 9, 100_000), ([], [0])):
        bits = lines.unpack_bitmap(lines.pack_bitmap(n, np.array(gone, int)), n)
        assert len(bits) == n and np.flatnonzero(~bits).tolist() == gone
    assert len(lines.pack_bitmap(100_000, np.array([5]))) < 100
