"""Pooling, repair, verification and split queries on the order, document and label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import vocab as V
from tickloom.operators import corpus, quality, splits
from tickloom.plans.registry import ACTIVITY, Tables, query

LINES = """a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 0 AS source FROM lineitem),
    b AS (SELECT CASE WHEN l_quantity > 25 THEN l_orderkey ELSE l_orderkey + 1000000 END, l_linenumber, l_partkey, l_suppkey, l_extendedprice + 1, 1 FROM lineitem),
    pool AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def pooled_lines(t: Tables):
    base = t.lineitem.select(*LINE_KEY, "l_extendedprice", "l_quantity")
    a = base.drop("l_quantity").withColumn("source", F.lit(0))
    moved = F.when(F.col("l_quantity") > 25, F.col("l_orderkey")).otherwise(F.col("l_orderkey") + 1000000)
    b = base.select(moved.alias("l_orderkey"), *LINE_KEY[1:], (F.col("l_extendedprice") + 1).alias("l_extendedprice"), F.lit(1).alias("source"))
    return a.unionByName(b)


@query(
    "dedupe_first_source",
    "U1",
    f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY source, l_extendedprice) AS n FROM pool)
    SELECT source::BIGINT AS source, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM r WHERE n = 1 GROUP BY 1""",
)
def dedupe_first_source(t: Tables):
    kept = corpus.first_source(pooled_lines(t), LINE_KEY, [F.col("source"), F.col("l_extendedprice")])
    return kept.groupBy(F.col("source").cast("long").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(
    "name_collisions",
    "U1",
    """SELECT DISTINCT p_name AS name, p_brand, n_sources FROM part JOIN (SELECT p_name AS name, count(DISTINCT p_brand) AS n_sources FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1) ON p_name = name""",
)
def name_collisions(t: Tables):
    return corpus.name_collisions(t.part.withColumnRenamed("p_name", "name"), "name", "p_brand")


TWO = """p AS (SELECT o_orderkey AS k, o_custkey AS g, 'hub' AS source FROM orders WHERE (o_orderpriority <> '1-URGENT' OR o_custkey % 3 > 0) AND (o_custkey % 3 > 0 OR o_custkey % 2 = 0)),
    s AS (SELECT o_orderkey AS k, o_custkey AS g FROM orders WHERE o_custkey % 3 <> 1)"""


def two_sources(t: Tables):
    o = t.orders.select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("g"), "o_orderpriority")
    primary = o.filter((F.col("o_orderpriority") != "1-URGENT") | (F.col("g") % 3 > 0)).filter((F.col("g") % 3 > 0) | (F.col("g") % 2 == 0))
    return primary.select("k", "g", F.lit("hub").alias("source")), o.filter(F.col("g") % 3 != 1).select("k", "g")


@query(
    "backfill_zero_overlap",
    "J12",
    f"""WITH {TWO},
    d AS (SELECT g FROM s LEFT JOIN (SELECT k, true AS hit FROM p) USING (k) GROUP BY g HAVING count(hit) = 0)
    SELECT k::BIGINT AS k, g::BIGINT AS g, source FROM p UNION ALL SELECT k, g, 'local-' || g FROM s WHERE g IN (SELECT g FROM d)""",
)
def backfill_zero_overlap(t: Tables):
    primary, secondary = two_sources(t)
    return corpus.backfill(primary, secondary, ["k"], "g", F.concat(F.lit("local-"), F.col("g").cast("string")))


@query(
    "backfill_fate",
    "J12",
    f"""WITH {TWO},
    c AS (SELECT s.g, count(*) AS n, count(p.k) AS dup FROM s LEFT JOIN p USING (k) GROUP BY 1)
    SELECT g::BIGINT AS g, n, dup, CASE WHEN dup = 0 THEN 'added' WHEN dup < n THEN 'partial' ELSE 'covered' END AS fate FROM c""",
)
def backfill_fate(t: Tables):
    primary, secondary = two_sources(t)
    return corpus.overlap_report(primary, secondary, ["k"], "g")


@query(
    "reuse_todo",
    "J11 S14",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'todo' ELSE 'reuse' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def reuse_todo(t: Tables):
    return corpus.reuse_todo(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query(
    "verified_join_status",
    "J10",
    """WITH m AS (SELECT o_orderkey AS k, o_custkey AS stem, o_orderkey % 7 + 1 AS want FROM orders), s AS (SELECT l_orderkey AS k, max(l_linenumber) AS top, count(*) AS n FROM lineitem GROUP BY 1),
    st AS (SELECT c_custkey AS stem, c_mktsegment <> 'BUILDING' AS complete FROM customer WHERE c_acctbal > 0)
    SELECT m.k::BIGINT AS k, CASE WHEN st.stem IS NULL THEN 'source_unavailable' WHEN NOT complete THEN 'source_columns_missing' WHEN s.top = m.want THEN 'verified' ELSE 'source_key_mismatch' END AS status
    FROM m LEFT JOIN st USING (stem) LEFT JOIN s USING (k)""",
)
def verified_join_status(t: Tables):
    meta = t.orders.select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").alias("stem"), (F.col("o_orderkey") % 7 + 1).alias("top"))
    side = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").alias("top"))
    stems = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("stem"), (F.col("c_mktsegment") != "BUILDING").alias("complete"))
    return corpus.verified_join(meta, side, ["k"], ["top"], stems, "stem", "complete").select("k", "status")


@query(
    "crop_meta",
    "F7",
    """WITH m AS (SELECT o_orderkey AS k, 20 + o_custkey % 10 AS n, 1000 + o_orderkey AS last, 20 + o_custkey % 10 - o_orderkey % 3 AS new_n, CASE WHEN o_custkey % 2 = 0 THEN 900 + o_orderkey END AS exact FROM orders)
    SELECT k::BIGINT AS k, new_n::BIGINT AS n_ticks, CASE WHEN new_n = n THEN last ELSE coalesce(exact, last - (n - new_n) * 8) END::BIGINT AS last_tick, CASE WHEN new_n = n THEN '-' WHEN exact IS NOT NULL THEN 'verified' ELSE 'estimated' END AS source FROM m""",
)
def crop_meta(t: Tables):
    c, k = F.col("o_custkey").cast("long"), F.col("o_orderkey").cast("long")
    meta = t.orders.select(k.alias("k"), (20 + c % 10).alias("n_ticks"), (1000 + k).alias("last_tick"), (20 + c % 10 - k % 3).alias("new_n"), F.when(c % 2 == 0, 900 + k).alias("exact"))
    out = corpus.cropped_meta(meta, "new_n", "exact", 8)
    return out.select("k", "n_ticks", "last_tick", F.coalesce("last_tick_source", F.lit("-")).alias("source"))


@query(
    "manifest_set_check",
    "J22 U5 U6",
    """WITH h AS (SELECT CASE WHEN toxic = 1 AND doc_id % 5 = 0 THEN NULL ELSE doc_id + quality END AS id FROM labels), w AS (SELECT doc_id AS id FROM documents WHERE n_chars > 500),
    a AS (SELECT id, count(*) AS n FROM h GROUP BY 1), b AS (SELECT id, count(*) AS n FROM w GROUP BY 1)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.n IS NOT NULL AND a.id IS NULL THEN 'null' WHEN b.n IS NULL THEN 'extra' WHEN a.n IS NULL THEN 'missing' END AS status FROM a FULL JOIN b ON a.id = b.id) WHERE status IS NOT NULL GROUP BY 1""",
)
def manifest_set_check(t: Tables):
    broken = (F.col("toxic") == 1) & (F.col("doc_id") % 5 == 0)
    have = t.labels.select(F.when(~broken, F.col("doc_id") + F.col("quality")).alias("id"))
    want = t.documents.filter("n_chars > 500").select(F.col("doc_id").alias("id"))
    return quality.id_differences(have, want, "id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "manifest_filter",
    "F3 F12",
    """SELECT p_partkey::BIGINT AS part FROM part WHERE p_size IS NOT NULL AND p_type = 'SMALL' AND (p_name LIKE '%ring%' OR p_name LIKE '%bolt%')""",
)
def manifest_filter(t: Tables):
    rows = t.part.withColumn("tags", F.split("p_name", " "))
    return corpus.match_fields(rows, tags=["ring", "bolt"], p_type="SMALL").select(F.col("p_partkey").cast("long").alias("part"))


@query(
    "authored_records",
    "F12",
    """SELECT p_partkey::BIGINT AS part FROM part WHERE p_size % 4 <> 0 AND p_size % 5 <> 0""",
)
def authored_records(t: Tables):
    a = F.when(F.col("p_size") % 4 == 0, "TODO: write").otherwise(F.col("p_name"))
    both = F.create_map(F.lit("A"), a, F.lit("B"), F.col("p_brand"))
    rows = t.part.withColumn("candidates", F.when(F.col("p_size") % 5 == 0, F.create_map(F.lit("A"), a)).otherwise(both))
    return corpus.authored(rows, "candidates", ["A", "B"]).select(F.col("p_partkey").cast("long").alias("part"))


MAPPED = f"[{', '.join(repr(m) for m in [*V.STATE_MAPS, 'de_train'])}]"


@query(
    "corpus_exclusions",
    "F2 F1",
    f"""WITH e AS (SELECT {MAPPED}[o_custkey % 9 + 1] AS map_name FROM orders), k AS (SELECT *, map_name NOT IN ('de_anubis', 'de_train') AND map_name <> 'de_vertigo' AS ok FROM e)
    SELECT map_name, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM k GROUP BY 1""",
)
def corpus_exclusions(t: Tables):
    maps = [*V.STATE_MAPS, "de_train"]
    rows = t.orders.select(F.element_at(F.array(*[F.lit(m) for m in maps]), (F.col("o_custkey") % 9 + 1).cast("int")).alias("map_name"))
    return corpus.kept_dropped(rows, "map_name", V.DEFECT_MAPS, [m for m in maps if m != "de_vertigo"])


RULES = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest([{'rule': 'discount above 8%', 'bad': l_discount > 0.085}, {'rule': 'quantity not positive', 'bad': l_quantity <= 0}, {'rule': 'returned but open', 'bad': l_returnflag = 'R' AND l_linestatus = 'O'},
      {'rule': 'tax above discount on small lines', 'bad': l_tax > l_discount AND l_quantity < 5}, {'rule': 'price not finite', 'bad': NOT isfinite(l_extendedprice)}, {'rule': 'no parent order', 'bad': o_orderkey IS NULL}, {'rule': 'ships before the order', 'bad': coalesce(l_shipdate < o_orderdate, false)},
      {'rule': 'price zero', 'bad': l_extendedprice = 0}]) AS x FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "invariant_report",
    "A28 X4 E4",
    f"""WITH {RULES} SELECT x.rule AS rule, count(*) AS bad_rows, count(DISTINCT l_orderkey) AS bad_episodes, min((l_orderkey, l_linenumber)).l_orderkey AS first_order
    FROM (SELECT x, l_orderkey, {{'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber}} AS p, l_linenumber FROM r) WHERE x.bad GROUP BY 1""".replace("min((l_orderkey, l_linenumber)).l_orderkey", "min(p).l_orderkey"),
)
def invariant_report(t: Tables):
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    c = F.col
    rules = {
        "discount above 8%": c("l_discount") > 0.085,
        "quantity not positive": c("l_quantity") <= 0,
        "returned but open": (c("l_returnflag") == "R") & (c("l_linestatus") == "O"),
        "tax above discount on small lines": (c("l_tax") > c("l_discount")) & (c("l_quantity") < 5),
        "price not finite": F.isnan("l_extendedprice") | (F.abs("l_extendedprice") == float("inf")),
        "no parent order": c("o_orderkey").isNull(),
        "ships before the order": c("l_shipdate") < c("o_orderdate"),
        "price zero": c("l_extendedprice") == 0,
    }
    report = quality.invariant_report(rows, rules, ["l_orderkey"], ["l_orderkey", "l_linenumber"])
    return report.select("rule", "bad_rows", "bad_episodes", F.col("first.l_orderkey").alias("first_order"))


@query(
    "integrity_status",
    "S16",
    """WITH f AS (SELECT page_id::VARCHAR AS name, sha256(html) AS sha, strlen(html) AS b FROM pages WHERE page_id % 10 <> 3),
    m AS (SELECT page_id::VARCHAR AS name, CASE WHEN page_id % 7 = 0 THEN sha256(url) ELSE sha256(html) END AS sha, CASE WHEN page_id % 5 = 0 THEN strlen(html) + 1 WHEN page_id % 5 = 1 THEN NULL ELSE strlen(html) END AS b FROM pages WHERE page_id % 10 <> 4)
    SELECT name, CASE WHEN f.sha IS NULL THEN 'MISSING' WHEN m.sha IS NULL THEN 'NO ENTRY' WHEN m.b IS NOT NULL AND m.b <> f.b THEN 'SIZE MISMATCH' WHEN m.sha = f.sha THEN 'OK' ELSE 'MISMATCH' END AS status FROM f FULL JOIN m USING (name)""",
)
def integrity_status(t: Tables):
    p, i = t.pages, F.col("page_id")
    name, size = i.cast("string").alias("name"), F.octet_length("html").cast("long")
    files = p.filter(i % 10 != 3).select(name, F.sha2("html", 256).alias("sha256"), size.alias("bytes"))
    sha = F.when(i % 7 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256))
    want = F.when(i % 5 == 0, size + 1).when(i % 5 != 1, size)
    manifest = p.filter(i % 10 != 4).select(name, sha.alias("sha256"), want.alias("bytes"))
    return quality.integrity(files, manifest)


@query(
    "lineage_upsert",
    "S17 S13",
    """WITH n AS (SELECT c_nationkey AS dest, max(c_custkey) AS v FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1)
    SELECT n_nationkey::BIGINT AS dest, CASE WHEN n.dest IS NULL THEN n_name ELSE 'patched' END AS script, coalesce(n.v, -1)::BIGINT AS version FROM nation LEFT JOIN n ON n.dest = n_nationkey""",
)
def lineage_upsert(t: Tables):
    old = t.nation.select(F.col("n_nationkey").cast("long").alias("dest"), F.col("n_name").alias("script"), F.lit(-1).cast("long").alias("version"))
    new = t.customer.filter("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").cast("long").alias("dest")).agg(F.lit("patched").alias("script"), F.max("c_custkey").cast("long").alias("version"))
    return corpus.upsert(old, new, ["dest"])


@query(
    "presence_registry",
    "S8 S9",
    """WITH k AS (SELECT doc_id AS stem, 'text' AS kind FROM documents UNION ALL SELECT doc_id, 'label' FROM labels UNION ALL SELECT page_id, 'page' FROM pages)
    SELECT stem, max((kind = 'text')::INT)::BIGINT AS has_text, max((kind = 'label')::INT)::BIGINT AS has_label, max((kind = 'page')::INT)::BIGINT AS has_page FROM k GROUP BY 1""",
)
def presence_registry(t: Tables):
    from tickloom.sources.inventory import registry

    kinds = [(t.documents, "doc_id", "text"), (t.labels, "doc_id", "label"), (t.pages, "page_id", "page")]
    rows = None
    for df, stem, kind in kinds:
        one = df.select(F.col(stem).alias("stem"), F.lit(kind).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    return registry(rows, ["text", "label", "page"])


@query(
    "stratified_split",
    "T6 A29",
    """WITH c AS (SELECT c_nationkey AS g, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1, 2), d AS (SELECT g, arg_min(s, (-n, s)) AS s FROM c GROUP BY 1),
    h AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ('0x' || substr(sha256(g || '#3'), 1, 13))::BIGINT, g) AS r, count(*) OVER (PARTITION BY s) AS m FROM d),
    p AS (SELECT g, s, CASE WHEN r <= greatest(round_even(0.15::DOUBLE * m, 0), CASE WHEN s IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END) THEN 'val' ELSE 'train' END AS split FROM h),
    e AS (SELECT c_mktsegment AS stratum, split FROM customer JOIN p ON p.g = c_nationkey)
    SELECT stratum, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, round(count(*) FILTER (split = 'val') / count(*), 6) AS share, NOT (count(*) FILTER (split = 'val') / count(*) BETWEEN 0.08 AND 0.3) AS skewed FROM e GROUP BY 1""",
)
def stratified_split(t: Tables):
    rows = t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("stratum"))
    marked = splits.stratified_group_split(rows, "g", "stratum", 0.15, ["BUILDING", "MACHINERY"], seed=3)
    out = quality.split_counts(marked, "stratum", "split")
    return out.withColumn("share", F.round("share", 6))


@query(
    "entity_split",
    "T5",
    """WITH g AS (SELECT DISTINCT user_id FROM events), h AS (SELECT user_id, row_number() OVER (ORDER BY ('0x' || substr(sha256(user_id || '#11'), 1, 13))::BIGINT, user_id) AS r, count(*) OVER () AS n FROM g)
    SELECT CASE WHEN r <= floor(n * (1 - 0.1::DOUBLE)) THEN 'train' ELSE 'val' END AS split, count(DISTINCT user_id) AS users, count(*) AS n FROM events JOIN h USING (user_id) GROUP BY 1""",
)
def entity_split(t: Tables):
    marked = splits.group_split(t.events.select("user_id"), "user_id", 0.1, seed=11)
    per = marked.groupBy("split", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("split").agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("n"))


@query(
    "nested_subset",
    "T7",
    """WITH g AS (SELECT DISTINCT source FROM documents ORDER BY ('0x' || substr(sha256(source || '#0'), 1, 13))::BIGINT, source LIMIT 5) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM g)""",
)
def nested_subset(t: Tables):
    return splits.nested_subset(t.documents.select("doc_id", "source"), "source", 5)


@query(
    "stratified_round_robin",
    "T8",
    """WITH h AS (SELECT doc_id, lang, source, n_chars, ('0x' || substr(sha256(doc_id || '#5'), 1, 13))::BIGINT AS h FROM documents), s AS (SELECT * FROM h WHERE (n_chars, doc_id) IN (SELECT (n_chars, arg_min(doc_id, (h, doc_id))) FROM h GROUP BY n_chars)),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS turn, ('0x' || substr(sha256(lang || '#' || source || '#5'), 1, 13))::BIGINT AS o FROM s)
    SELECT doc_id, lang, source FROM r ORDER BY turn, o, doc_id LIMIT 200""",
)
def stratified_round_robin(t: Tables):
    rows = t.documents.select("doc_id", "lang", "source", "n_chars")
    return splits.round_robin(rows, ["lang", "source"], ["n_chars"], "doc_id", 200, seed=5).select("doc_id", "lang", "source")


@query(
    "global_topk_tiebreak",
    "T1 T2",
    """SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars // 100 DESC, sha1(doc_id::VARCHAR) LIMIT 100""",
)
def global_topk_tiebreak(t: Tables):
    fresh = corpus.pending(t.documents.select("doc_id", "n_chars"), t.labels, ["doc_id"])
    scored = fresh.withColumn("score", F.floor(F.col("n_chars") / 100))
    return splits.top_by_score(scored, "score", F.col("doc_id"), 100).select("doc_id", "n_chars")


@query(
    "seeded_sample",
    "T3",
    """SELECT o_orderkey::BIGINT AS order_key FROM orders ORDER BY sha256(o_orderkey || '#9') LIMIT 500""",
)
def seeded_sample(t: Tables):
    return splits.sample_by_hash(t.orders.select(F.col("o_orderkey").cast("long").alias("order_key")), [F.col("order_key")], 500, seed=9)


@query(
    "top_groups",
    "T4",
    """SELECT o_custkey::BIGINT AS customer, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, customer LIMIT 20""",
)
def top_groups(t: Tables):
    return splits.top_groups(t.orders.select(F.col("o_custkey").cast("long").alias("customer")), ["customer"], 20)


PREFS = """c AS (SELECT conv_id, max(CASE WHEN turn = 1 THEN text END) AS a, max(CASE WHEN turn = 3 THEN text END) AS b FROM conversations GROUP BY 1), k AS (SELECT * FROM c WHERE a IS NOT NULL AND b IS NOT NULL),
    l AS (SELECT DISTINCT conv_id, ['A', 'B', 'tie', 'skip', 'A'][conv_id % 5 + 1] AS choice, CASE WHEN ('0x' || substr(sha256(conv_id || '#1'), 1, 13))::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END AS first_shown FROM conversations)"""


@query(
    "preference_resolve",
    "J14 T9",
    f"""WITH {PREFS}, r AS (SELECT *, (choice = 'A') <> (first_shown = 'B') AS pa FROM l LEFT JOIN k USING (conv_id))
    SELECT conv_id, CASE WHEN a IS NULL THEN 'orphan' WHEN choice IN ('A', 'B') THEN 'pair' ELSE choice END AS outcome, coalesce(md5(CASE WHEN choice IN ('A', 'B') THEN CASE WHEN pa THEN a ELSE b END END), '-') AS chosen,
      coalesce(md5(CASE WHEN choice IN ('A', 'B') THEN CASE WHEN pa THEN b ELSE a END END), '-') AS rejected, CASE WHEN choice IN ('A', 'B') THEN CASE WHEN pa THEN 'A' ELSE 'B' END ELSE choice END AS canonical FROM r""",
)
def preference_resolve(t: Tables):
    turns = {"completion_a": 1, "completion_b": 3}
    cands = t.conversations.groupBy("conv_id").agg(*[F.max(F.when(F.col("turn") == n, F.col("text"))).alias(c) for c, n in turns.items()])
    cands = cands.filter("completion_a IS NOT NULL AND completion_b IS NOT NULL")
    choice = F.element_at(F.array(*[F.lit(x) for x in ("A", "B", "tie", "skip", "A")]), (F.col("conv_id") % 5 + 1).cast("int"))
    labels = splits.display_swap(t.conversations.select("conv_id").distinct().withColumn("choice", choice), F.col("conv_id"), seed=1)
    out = corpus.resolve_preferences(labels, cands, "conv_id")
    return out.select("conv_id", "outcome", F.coalesce(F.md5("chosen"), F.lit("-")).alias("chosen"), F.coalesce(F.md5("rejected"), F.lit("-")).alias("rejected"), "canonical")


@query(
    "indexed_join",
    "J15",
    """SELECT d.doc_id, d.n_chars, md5(d.text) AS digest FROM documents d""",
)
def indexed_join(t: Tables):
    return corpus.indexed_join(t.documents.select("doc_id", "n_chars"), t.documents.select("doc_id", F.md5("text").alias("digest")), "doc_id")


@query(
    "label_file_resolution",
    "J26",
    """WITH f AS (SELECT doc_id FROM documents WHERE n_chars > 300), p AS (SELECT l.doc_id, i AS pos, l.doc_id - i AS prior FROM labels l, (SELECT unnest([3, 2, 1]) AS i)),
    g AS (SELECT p.doc_id, array_to_string(list(f.doc_id ORDER BY pos DESC), ',') AS priors FROM p JOIN f ON f.doc_id = p.prior GROUP BY 1)
    SELECT l.doc_id, coalesce(g.priors, '') AS priors FROM labels l JOIN f USING (doc_id) LEFT JOIN g USING (doc_id) WHERE l.toxic = 0""",
)
def label_file_resolution(t: Tables):
    files = t.documents.filter("n_chars > 300").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    labels = t.labels.select("doc_id", F.array(*[F.col("doc_id") - i for i in (3, 2, 1)]).alias("priors"))
    out = corpus.resolve_files(labels, files, "doc_id", "priors", allowed=t.labels.filter("toxic = 0"))
    return out.select("doc_id", F.array_join("prior_paths", ",").alias("priors"))


@query(
    "tick_gap_share",
    "A36",
    """WITH d AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem) SELECT k, count(*) AS present, max(n) - min(n) + 1 AS expected, round(1 - count(*) / (max(n) - min(n) + 1), 8) AS missing_share FROM d GROUP BY 1""",
)
def tick_gap_share(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"))
    return quality.tick_gaps(rows, ["k"], "n", 1).withColumn("missing_share", F.round("missing_share", 8))


@query(
    "column_profile",
    "A39",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min({c}) AS lo, round(avg({c}), 6) AS mean, max({c}) AS hi, round(avg(({c} <> 0)::INT), 8) AS rate FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def column_profile(t: Tables):
    out = quality.column_profile(t.lineitem, ["l_quantity", "l_discount", "l_tax"])
    return out.select("column", "lo", F.round("mean", 6).alias("mean"), "hi", F.round("rate", 8).alias("rate"))


@query(
    "vocabulary",
    "A32 S2",
    """WITH w AS (SELECT DISTINCT p_name AS word FROM part) SELECT 0::BIGINT AS id, '<missing>' AS word UNION ALL SELECT row_number() OVER (ORDER BY word), word FROM w""",
)
def vocabulary(t: Tables):
    return quality.vocabulary(t.part, "p_name")


@query(
    "score_histogram",
    "A31",
    """WITH s AS (SELECT least(4, greatest(0, floor((l_extendedprice / 80000) * 5)))::BIGINT AS bin FROM lineitem) SELECT bin, count(*) AS n FROM s GROUP BY 1""",
)
def score_histogram(t: Tables):
    return quality.histogram(t.lineitem.withColumn("s", F.col("l_extendedprice") / 80000), "s", 5)


@query(
    "source_summary",
    "A38",
    """WITH e AS (SELECT source, lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2) SELECT coalesce(source, 'ALL') AS source, count(*) AS langs, sum(docs)::BIGINT AS docs, sum(chars)::BIGINT AS chars FROM e GROUP BY ROLLUP (source)""",
)
def source_summary(t: Tables):
    e = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    out = e.rollup("source").agg(F.count(F.lit(1)).alias("langs"), F.sum("docs").alias("docs"), F.sum("chars").alias("chars"))
    return out.withColumn("source", F.coalesce("source", F.lit("ALL")))


@query(
    "first_event",
    "A37 F8 U2",
    f"""WITH {ACTIVITY} SELECT user_id, count(*) AS errors, arg_min(event_id, (us, event_id)) AS first_id, min(us) AS first_us FROM activity WHERE event_type = 'error' AND NOT (value = 0) GROUP BY 1""",
)
def first_event(t: Tables):
    real = t.activity.filter((F.col("event_type") == "error") & ~F.col("value").eqNullSafe(0.0))
    first = F.min(F.struct("us", "event_id"))
    return real.groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"), first.alias("f")).select("user_id", "errors", F.col("f.event_id").alias("first_id"), F.col("f.us").alias("first_us"))


@query(
    "episode_export",
    "S13 S10",
    f"""WITH {ACTIVITY}, p AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) // 32 AS part FROM activity)
    SELECT user_id, part, count(*) AS n, md5(string_agg(event_id::VARCHAR || ':' || event_type, ',' ORDER BY us, event_id)) AS digest FROM p GROUP BY 1, 2""",
)
def episode_export(t: Tables):
    from tickloom.sources.sinks import nest_frames

    doc = nest_frames(t.activity, ["user_id"], "us", ["event_id", "event_type"], tie=["event_id"], per_part=32)
    listed = F.array_join(F.transform("frames", lambda f: F.concat_ws(":", f["event_id"].cast("string"), f["event_type"])), ",")
    return doc.select("user_id", "part", F.size("frames").cast("long").alias("n"), F.md5(listed).alias("digest"))


def scratch(t: Tables) -> str:
    """A fresh folder for one run, under the shared checkpoint directory."""
    import uuid

    from tickloom.session import checkpoint_dir

    return f"{checkpoint_dir(t.spark)}/files/{uuid.uuid4().hex}"


@query(
    "manifest_last_wins",
    "S4 S5 S6 S12",
    """SELECT o_custkey::BIGINT AS id, max(o_orderkey)::BIGINT AS seq, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders WHERE o_orderkey % 11 <> 5 GROUP BY 1""",
)
def manifest_last_wins(t: Tables):
    from tickloom.sources import readers

    path = scratch(t)
    row = F.to_json(F.struct(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("priority")))
    broken = F.when(F.col("o_orderkey") % 11 == 5, F.concat(F.lit("{oops "), F.col("o_orderpriority"))).otherwise(row)
    t.orders.select(broken.alias("value")).write.text(path)
    entries, _ = readers.read_manifest(t.spark, path, "id bigint, seq bigint, priority string")
    return entries


@query(
    "event_list_files",
    "S10",
    f"""WITH {ACTIVITY} SELECT 'rec' || (user_id % 10) AS demo_stem, count(*) AS n, sum(us // 1000000 % 100000)::BIGINT AS ticks FROM activity WHERE event_type = 'error' GROUP BY 1""",
)
def event_list_files(t: Tables):
    from tickloom.sources import readers

    # JSON lines in a folder per recording
    path = scratch(t)
    stem = F.format_string("rec%d", F.col("user_id") % 10)
    rows = t.activity.filter("event_type = 'error'").select(stem.alias("demo_stem"), (F.floor(F.col("us") / 1_000_000) % 100000).cast("int").alias("tick"))
    rows.write.partitionBy("demo_stem").json(path)
    read = t.spark.read.schema(f"{readers.KILLS}, demo_stem string").json(path)
    return read.groupBy("demo_stem").agg(F.count(F.lit(1)).alias("n"), F.sum("tick").alias("ticks"))


@query(
    "guarded_publish",
    "F9 S10 S15 E4",
    """SELECT l_returnflag AS split, l_linestatus AS map_name, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2""",
)
def guarded_publish(t: Tables):
    from tickloom.sources import sinks

    home = scratch(t)
    rows = t.lineitem.select(F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("map_name"), "l_orderkey", "l_quantity", F.lit("v1").alias("version"))

    def verify(staged):
        quality.require_single(staged, "version", "schema versions")
        rules = {"quantity": F.col("l_quantity") <= 0, "flag": ~F.col("split").isin("A", "N", "R")}
        quality.require_clean(quality.invariant_report(staged, rules, ["l_orderkey"], ["l_orderkey"]))

    sinks.publish_clean(rows, f"{home}/staging", f"{home}/frames", verify)
    out = t.spark.read.parquet(f"{home}/frames")
    return out.groupBy("split", "map_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query(
    "label_documents",
    "S4",
    """SELECT count(*) AS readable, sum(quality)::BIGINT AS quality FROM labels WHERE doc_id % 9 <> 2""",
)
def label_documents(t: Tables):
    from tickloom.sources import readers

    # one small document per line
    path = scratch(t)
    body = F.to_json(F.struct("doc_id", "quality"))
    t.labels.select(F.when(F.col("doc_id") % 9 == 2, F.lit("{oops")).otherwise(body).alias("value")).write.text(path)
    lines = readers.read_lines(t.spark, path, "doc_id bigint, quality int")
    return lines.filter("doc_id IS NOT NULL").agg(F.count(F.lit(1)).alias("readable"), F.sum("quality").alias("quality"))
