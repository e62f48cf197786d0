"""The text operators against brute force on small tables with nulls, empty texts, repeats and clashing names."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, decontam, jaccard, langid, licences, slots, urls, winnow
from tickloom.llm.common import scratch
from tickloom.llm.queries import urls as url_query

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Documents beside columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", "y", 2.0) for i, t in rows], "doc_id long, text string, n int, cls string, verdict string, score double")


# ---- 1: URLs


def judge(rules, url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


URLS = [
    "http://A.Example.NET/en/1?x#y", "https://example.net/de/", "http://net/", "http://net", "http://xnet/", "http://casino-win.example.com/de/1", "ftp://u@h.org/fr/a/b#c", "http://org/fr", None, "", "no url",
    "a://b://c/d", "http://É.Example.com/de/É?q=http://x.net/", "http://example.net#f", "http://ex.test/" + "a/" * 4000, "http://ex.test/1", "http://ex.test/1",
]


def test_urls(spark):
    model = urls.fit_url_model(url_query.labelled(type("T", (), {"spark": spark})))
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, model, url_query.RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = judge(url_query.RULES, u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= 0.5 else "allow"))
    assert got[15]["score"] == got[16]["score"]
    assert urls.judge_urls(pages.limit(0), model, []).count() == 0
    new = spark.createDataFrame([(0, "http://poker-casino.test/en/3"), (1, "http://www.public-library.test/en/3")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge_urls(new, model).orderBy("page_id").collect()] == ["block", "allow"]


# ---- 2: licences


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        ("LICENSE", gpl), ("a.txt", "plain words"), ("x/b.txt", None), ("x/LICENSE.md", mit), ("x/y/z/c.txt", ""), ("x/y/z/c.txt", ""), ("x/d.txt", "first line\n" + gpl + "\nmore"),
        ("w/e.txt", "one. two! " + mit.upper() + " three"), (None, "no path"), ("x2/f.txt", "the license of the work"), ("x/g.txt", "word " * 5000 + "\n" + mit),
    ]
    table = spark.createDataFrame([(i, p, t, "own") for i, (p, t) in enumerate(files)], "id int, path string, text string, licence string")
    from tickloom.llm.queries.licences import TEMPLATES

    got = {r["id"]: (r["licence"], r["how"], r["origin"]) for r in licences.scan(table, TEMPLATES, keep=("id",)).collect()}
    assert got == {
        0: ("GPL-3.0", "own", None), 1: ("GPL-3.0", "inherited", ""), 2: ("MIT", "inherited", "x"), 3: ("MIT", "own", None), 4: ("MIT", "inherited", "x"), 5: ("MIT", "inherited", "x"),
        6: ("GPL-3.0", "own", None), 7: ("MIT", "own", None), 8: ("GPL-3.0", "inherited", ""), 9: ("GPL-3.0", "inherited", ""), 10: ("MIT", "own", None),
    }
    assert licences.scan(table.limit(0), TEMPLATES, keep=("id",)).count() == 0
    # rows in another order, and behind a union and a join, have the same licences
    other = table.unionByName(table.withColumn("id", F.col("id") + 100)).join(spark.range(200).withColumnRenamed("id", "of"), F.col("id") == F.col("of")).drop("of")
    for shuffled in (table.repartition(7), other.repartition(5)):
        again = {r["id"]: (r["licence"], r["how"], r["origin"]) for r in licences.scan(shuffled, TEMPLATES, keep=("id", "licence")).collect()}
        assert again == {i: got[i % 100] for i in again} and len(again) in (len(got), 2 * len(got))


def test_equal_licence_files_of_one_directory(spark):
    from tickloom.llm.queries.licences import TEMPLATES

    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = spark.createDataFrame([("d/LICENSE.a", mit), ("d/LICENSE.b", gpl), ("d/x", "text"), ("e/LICENSE", mit), ("e/LICENSE", mit), ("e/y", None)], "path string, text string")
    got = {r["path"]: r["licence"] for r in licences.scan(files, TEMPLATES).collect()}
    assert got["d/x"] == min("MIT", "GPL-3.0") and got["e/y"] == "MIT"


# ---- 4: Jaccard join


def brute_components(rows, k, num, den):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = word.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i), d))) for i, (d, _) in enumerate(rows))


def copies(seed=1):
    import random

    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(5, None), (6, ""), (7, " \t "), (8, "One two"), (9, "one  TWO"), (10, "two one"), (11, "a b c d"), (12, "a b c d"), (12, "a b c d"), (None, "a b c d"), (None, "nobody's words at all here")]
    at = 20
    for size in (40, 120, 120, 300):  # graded near copies of several bases; some only link through others
        base = [rng.choice(vocabulary) for _ in range(size)]
        for edits in [0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 4, 6, 9]:
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((at, " ".join(words)))
            at += 1
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for step in range(12):  # each near only to its neighbours
        rows.append((200 - step, " ".join(chain)))
        chain = [*chain[3:], *(rng.choice(vocabulary) for _ in range(3))]
    rows.append((300, "long " * 30_000))
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_components(spark, k, num, den):
    rows = copies()
    got = jaccard.components(docs(spark, rows).repartition(3), k=k, num=num, den=den).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, k, num, den)


def passages(seed=2):
    """Exact copies of texts, and the same texts with a rarer passage appended or inserted."""
    import random

    rng = random.Random(seed)
    rows, words = [], iter(f"v{i}" for i in range(10**6))

    def text(n):
        return [next(words) for _ in range(n)]

    for k in (4, 5, 2):
        for copied, added in ((90, 10), (93, 10), (60, 9), (120, 14), (200, 30)):
            passage = text(added)
            for at in (None, None, 0, rng.randrange(copied)):  # each passage stands in several texts, but in fewer than they have copies
                base = text(copied + k - 1)
                longer = [*base, *passage] if at is None else [*base[:at], *passage, *base[at:]]
                rows += [" ".join(base)] * rng.choice((3, 6)) + [" ".join(longer)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_components_with_rarer_passages(spark, k, num, den):
    rows = passages()
    got = jaccard.components(docs(spark, rows).repartition(3), k=k, num=num, den=den).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, k, num, den)


def test_no_documents_no_components(spark):
    assert jaccard.components(docs(spark, [])).count() == 0
    assert jaccard.components(docs(spark, [(1, None)])).collect()[0]["component_id"] == 1


# ---- 6: language


def test_language(spark):
    words = {"aa": "alpha beta gamma delta".split(), "bb": "uno dos tres cuatro".split(), "cc": "ein zwei drei vier".split()}
    rows = [(i, " ".join(w[(i + j * j) % 4] for j in range(9)), name) for i in range(60) for name, w in words.items()]
    rows += [(900, None, "aa"), (901, "nothing", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table, per_language=30)
    odd = [(0, None), (1, ""), (2, "123 !?"), (3, "zwei drei vier ein"), (4, "DOS TRES"), (5, "alpha " * 40_000), (6, "x"), (6, "x")]
    got = defaultdict(list)
    for r in langid.predict(docs(spark, odd).withColumnRenamed("verdict", "lang_pred"), model).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
        assert 0 <= r["score"] <= 1 and r["n"] == 1
    assert [got[i][0][0] for i in range(6)] == ["und", "und", "und", "cc", "bb", "aa"]
    assert got[6][0] == got[6][1]
    nothing = langid.fit(table.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs(spark, odd), nothing).collect()} == {"und"}
    assert langid.predict(docs(spark, []), model).count() == 0


def test_sample_of_rows_without_an_id(spark):
    rows = [(None if name == "aa" else i, f"{word} {i} {word}", name) for i in range(400) for name, word in (("aa", "alpha"), ("bb", "uno"))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(table, per_language=40).languages == ("aa", "bb")


def test_language_stage_without_labels(spark):
    import corpus_pipeline

    table = spark.createDataFrame([(1, "clean words", None), (2, "12 !", None), (3, None, None), (4, "élan", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, table, "").collect()) == [1, 4]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12])
def test_codewords_differ(n):
    code = langid.codewords(n).astype(int)
    gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(gaps) >= (1 if n == 2 else 2) and all(abs(c.sum()) < n for c in code.T)


def test_held_out_accuracy(spark):
    from tickloom.llm.queries.langid import op6_ecoc_language
    from tickloom.llm.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    rows = op6_ecoc_language(t).filter("held_out").join(t.documents.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows) > 0


# ---- 7 and 9: winnowing


def brute_kept(hashes, span):
    kept = []
    for i in range(len(hashes) - span + 1):
        j = min(range(i, i + span), key=lambda x: (hashes[x] >> winnow.PLACE_BITS, -x))
        if not kept or kept[-1] != j:
            kept.append(j)
    return [(j, hashes[j] >> winnow.PLACE_BITS) for j in kept]


def test_winnowing_keeps_least_hashes_rightmost_ties(spark):
    texts = ["a b a b a b a b c d e f", "one two three", "", None, "x" * 100, "é ü 漢字 !!", "q " * 3000, "k l m n o p q r s t u v w"]
    table = docs(spark, list(enumerate(texts)))
    units = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(winnow.UNIT), F.lit(0))
    rows = table.select("doc_id", winnow.gram_hashes(units, 3).alias("h"), F.size(units).alias("n"), winnow.fingerprint(F.col("text")).alias("fp")).collect()
    for r in rows:
        fp = [(x["at"], x["hash"]) for x in r["fp"]]
        if len(r["h"]) >= 4:
            assert fp == brute_kept(r["h"], 4)
        else:
            assert len(fp) == (r["n"] > 0)


def test_every_place_of_the_longest_text_has_a_number(spark):
    last = (1 << 31) - 2  # a Spark string has fewer than 2**31 bytes
    row = spark.range(1).select(F.array(F.lit(-5).cast("bigint"), F.lit(12345678901234567)).alias("h"))
    code = (F.get("h", F.lit(1)).bitwiseAND(F.lit(~winnow.PLACES))).bitwiseOR(F.lit(winnow.PLACES) - F.lit(last))
    got = row.select(winnow.place_of(code).alias("place"), winnow.hash_of(code).alias("hash"), F.transform(winnow.coded(F.col("h")), winnow.place_of).alias("places")).first()
    assert (got["place"], got["hash"], got["places"]) == (last, 12345678901234567 >> 31, [0, 1])


def test_half_edited(spark):
    rows = [(3, "abcdefg"), (-2, "é😀x"), (10, None), (4, ""), (7, "one two three four five six seven eight"), (7, "one two three four five six seven eight"), (None, "first of all"), (12, "tail")]
    got = winnow.half_edited(docs(spark, rows)).collect()
    order = sorted(((i is not None, i or 0), t or "", i) for i, t in rows)
    texts = [t for _, t, _ in order]
    want = []
    for k, (_, t, i) in enumerate(order):
        after, half = texts[(k + 1) % len(texts)], len(t) // 2
        want.append((str(i), len(t), t[: len(t) - half] + after[:half]))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    many = [(i, f"text {i} " + "w " * i) for i in range(0, 90, 3)]
    found = {r["doc_id"]: r["next_text"] for r in winnow.with_next(docs(spark, many), "doc_id", "text", rows_per_bucket=4).collect()}
    assert found == {i: many[(k + 1) % len(many)][1] for k, (i, _) in enumerate(many)}
    assert winnow.half_edited(docs(spark, [])).count() == 0


def test_contamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = [(1, item), (2, "short item"), (3, None), (4, ""), (5, item), (10, "Tick tick tick tick tick tick tick tick tick tick tick")]
    rows = [
        (1, "x " + item.upper() + " y"), (2, " ".join(item.split()[:9])), (3, "a short-item b"), (4, None), (5, ""), (5, item), (6, "tick " * 25), (None, "tick " * 10), (7, "word " * 30_000 + item),
        (8, " ".join(item.split()[1:11])), (9, "clean"), (9, "clean"), (11, "Éalpha beta " + item[12:]),
    ]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    spans = defaultdict(set)
    for i, t in bench:
        w = word.findall((t or "").translate(LOWER))
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            spans[tuple(w[s : s + m])].add(i)
    want = []
    for d, t in rows:
        w = word.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for m in {len(s) for s in spans}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in spans:
                    hit.update(range(s, s + m))
                    items |= spans[tuple(w[s : s + m])]
        want.append((str(d), len(w), len(hit), len(items), ",".join(sorted(map(str, items))), bool(hit)))
    items = spark.createDataFrame(bench, "item_id long, text string")
    for sent in (decontam.BROADCAST_BYTES, 0):  # windows sent to the tasks, or met by a shuffle
        found = decontam.contamination(docs(spark, rows).repartition(2), items, broadcast_bytes=sent).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in found) == sorted(want)
    assert not any(r["contaminated"] for r in decontam.contamination(docs(spark, rows), items.limit(0)).collect())
    assert decontam.contamination(docs(spark, []), items).count() == 0


# ---- 8: shards


def test_slots(spark):
    rows = [(i, i % 7 * 100 + 1, i) for i in range(500)] + [(None, 5, 1), (3, 301, 3), (3, 301, 3)]
    table = spark.createDataFrame([(*r, 9, "s") for r in rows], "doc_id long, size long, text_crc32 long, shard int, vslot string")
    got = slots.shard_records(table, 8, scratch(spark, "map"), slots=256, group_rows=20).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(rows)
    loads, places = Counter(), defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["position"])
    assert max(loads.values()) - min(loads.values()) <= 100
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert slots.shard_records(table.limit(0), 8, scratch(spark, "map")).count() == 0


def test_a_grown_map_moves_slots_only_to_the_new_shard():
    old = slots.SlotMap.initial(40)
    new = old.grown()
    moved = [(a, b) for a, b in zip(old.shard_of, new.shard_of) if a != b]
    assert {b for _, b in moved} == {40} and len(moved) == slots.VSLOTS // 41
    held = Counter(new.shard_of)
    assert max(held.values()) - min(held.values()) <= 3 and new.version == 2


# ---- 10: chats


def test_rotation(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|assistant|>"), (1, 2, "bob", None), (1, 300, "ann", "late"), (1, 300, "ann", "late"), (2, 0, "system", "alone"),
        (None, 0, "ann", "no id"), (3, None, None, "who"), (3, 0, "x", "é😀"),
    ]
    table = spark.createDataFrame([(*t, "p", 1) for t in turns], "conv_id long, turn long, role string, text string, speaker string, part int")
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.rotate(table, part_turns=3).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (None, "ann", 0), (3, "x", 0)}
    a = got[1, "ann", 0]
    assert a["text"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |assistant|><|end|>\n<|user name=bob|>\n<|end|>\n"
    assert [a["text"][s["start"] : s["stop"]] for s in a["spans"]] == ["hi < |assistant|>"]
    assert got[1, "bob", 1]["text"] == "<|user name=ann|>\nlate<|end|>\n" * 2 and got[1, "bob", 1]["spans"] == []
    assert [got[1, "ann", 1]["text"][s["start"] : s["stop"]] for s in got[1, "ann", 1]["spans"]] == ["late", "late"]
    x = got[3, "x", 0]
    assert x["text"] == "<|user name=unknown|>\nwho<|end|>\n<|assistant|>\né😀<|end|>\n"
    assert [x["text"][s["start"] : s["stop"]] for s in x["spans"]] == ["é😀"]
    assert chat.rotate(table.limit(0)).count() == 0
    # a hot null conversation without numbers is cut as well
    hot = spark.range(40).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("u").alias("role"), F.lit("same").alias("text"))
    assert sorted((r["part"], r["n_turns"]) for r in chat.rotate(hot, part_turns=8).collect()) == [(i, 8) for i in range(5)]


# ---- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a very large jug of odd liquids for the queen of spades"
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, base, "en"), (2, base, "en"), (2, base, "en"), (3, base + " today", "en"), (4, "1234 5678", "en"), (5, None, None), (6, "une autre histoire du village et de la rivière sous le pont", "fr"), (7, "words " + bench, "en"), (None, "a text with no id at all in it", "en")]
    table = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "extra") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    folder = "/root/testdata/sf0.001"
    kept = c.language(spark, table, folder)
    assert kept.columns == table.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 2, 3, 6, 7, None]))
    single = c.near_duplicates(spark, kept, folder)
    assert single.columns == table.columns and sorted(str(r["doc_id"]) for r in single.collect()) == sorted(map(str, [1, 6, 7, None]))
    clean = c.leaks(spark, single, folder)
    assert clean.columns == table.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(map(str, [1, 6, None]))
    packed = c.sequences(spark, clean, folder).collect()
    assert {str(r["doc_id"]) for r in packed} == {"1", "6", "None"}
    assert all(len(r["ids"]) == 4 * r["length"] for r in packed)
    twice = spark.createDataFrame([(2, base, "en", "s", 1, "e")] * 3, table.schema)
    assert c.near_duplicates(spark, twice, folder).count() == 1
    for _, stage in c.STAGES:
        assert stage(spark, table.limit(0), folder).count() == 0


def test_queries_match_their_sql(spark):
    from oracle import check, duck

    from tickloom.llm import load_llm_queries

    folder = "/root/testdata/sf0.001"
    queries = load_llm_queries()
    assert sorted(queries, key=lambda n: int(n[2:].split("_")[0])) == list(queries)
    for q in queries.values():
        problem, rows, _ = check(spark, duck(folder), folder, q)
        assert not problem and rows > 0, q.name


def test_sha_of_items_is_of_the_sorted_list(spark):
    from tickloom.llm.queries.decontam import op9_winnowing_decontamination
    from tickloom.llm.registry import Tables

    clean = hashlib.sha256(b"").hexdigest()
    rows = op9_winnowing_decontamination(Tables(spark, "/root/testdata/sf0.001")).collect()
    assert all((r["items_sha256"] == clean) == (r["n_items"] == 0) for r in rows)
