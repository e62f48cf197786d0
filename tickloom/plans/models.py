"""Model-fitting queries. Spark ML fits are checked for shape; fixed-point iterations have SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import ml, splits
from tickloom.plans.registry import Tables, query


def rounded(df, *columns):
    return df.select(*[F.round(c, 4).alias(c) if c in columns else c for c in df.columns])


def embedded(t: Tables):
    rows = t.embeddings.select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"), (F.col("label") % 2).cast("int").alias("odd"), F.col("label").cast("string").alias("kind"))
    marked = splits.group_split(rows, "vec_id", 0.3, seed=1)
    return marked.filter("split = 'train'"), marked.filter("split = 'val'")


@query("linear_probe", "M1 A11")
def linear_probe(t: Tables):
    train, test = embedded(t)
    scored = ml.fit_probe(train, test, "embedding", "y")
    return rounded(ml.probe_report(scored, "y", ["kind"]), "accuracy", "majority", "lift", "auc")


@query("multi_target_probe", "M3")
def multi_target_probe(t: Tables):
    train, test = embedded(t)
    return rounded(ml.multi_probe(train, test, "embedding", ["y", "odd"]), "accuracy", "majority", "lift", "auc")


@query("learning_curve", "M4 T7")
def learning_curve(t: Tables):
    train, test = embedded(t)
    return rounded(ml.learning_curve(train, test, "embedding", "y", "kind", [4, 7, 10]), "accuracy", "majority", "lift", "auc")


@query("ablation_probe", "M5 P13")
def ablation_probe(t: Tables):
    train, test = embedded(t)
    presets = {"baseline": [], "no_first_half": range(32), "no_second_half": range(32, 64)}
    return rounded(ml.ablation_table(train, test, "embedding", "y", 64, presets), "accuracy", "majority", "lift", "auc")


@query("tfidf_lr", "M2 A26")
def tfidf_lr(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "source", "quality", "lang")
    marked = splits.group_split(rows, "source", 0.25, seed=2)
    scored = ml.text_classifier(marked.filter("split = 'train'"), marked.filter("split = 'val'"), "text", "quality")
    return rounded(ml.probe_report(scored, "quality", ["lang"]), "accuracy", "majority", "lift", "auc")


@query("preference_model", "M6 J14")
def preference_model(t: Tables):
    # neighbouring vectors form a preference: the higher label was chosen
    e = t.embeddings.select("vec_id", "embedding", "label")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    pair = e.join(nxt, "vec_id").filter("label <> other_label")
    first = F.col("label") > F.col("other_label")
    pairs = pair.select(F.when(first, F.col("embedding")).otherwise(F.col("other")).alias("c"), F.when(first, F.col("other")).otherwise(F.col("embedding")).alias("r"))
    model = ml.preference_model(pairs, "c", "r")
    scored = ml.preference_score(model, e, "embedding")
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("variance_components", "A27")
def variance_components(t: Tables):
    return ml.variance_components(t.embeddings, "embedding", 64)


DISTANCE = "(v[1] - c[1]) * (v[1] - c[1]) + (v[2] - c[2]) * (v[2] - c[2]) + (v[3] - c[3]) * (v[3] - c[3])"
CODED = f"list_sort(list_transform(cs, lambda c, i: {{'d': {DISTANCE}, 'i': i}}))[1]"


@query(
    "codebook_report",
    "A34",
    f"""WITH RECURSIVE r AS (SELECT l_orderkey || '.' || l_linenumber AS k, l_returnflag, [l_extendedprice / 1000, l_quantity, l_discount * 100]::DOUBLE[] AS v FROM lineitem),
    s(step, cs) AS (SELECT 0, list(v ORDER BY md5(k), k, v) FROM (SELECT * FROM r ORDER BY md5(k), k, v LIMIT 16)
      UNION ALL SELECT step, list(coalesce(fresh, old) ORDER BY i) FROM (
        SELECT any_value(step) + 1 AS step, i, any_value(cs)[i] AS old, CASE WHEN count(v) > 0 THEN [avg(v[1]), avg(v[2]), avg(v[3])] END AS fresh FROM (
          SELECT step, cs, {CODED}.i AS i, v FROM s, r WHERE step < 8 UNION ALL SELECT step, cs, unnest(range(1, len(cs) + 1)), NULL FROM s WHERE step < 8) GROUP BY i) GROUP BY step)
    SELECT l_returnflag, count(*) AS n, round(sqrt(avg(near.d)), 4) AS rmse, count(DISTINCT near.i) AS codes_used FROM (SELECT l_returnflag, {CODED} AS near FROM r, s WHERE step = 8) GROUP BY 1""",
)
def codebook_report(t: Tables):
    v = F.array(F.col("l_extendedprice") / 1000, F.col("l_quantity"), F.col("l_discount") * 100)
    rows = t.lineitem.select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("k"), "l_returnflag", F.transform(v, lambda x: x.cast("double")).alias("v"))
    return rounded(ml.codebook_report(rows, "k", "v", 16, ["l_returnflag"], 8), "rmse")


@query(
    "preference_strengths",
    "M6",
    """WITH RECURSIVE g AS (SELECT l_suppkey % 40 AS a, lead(l_suppkey % 40) OVER w AS b, l_extendedprice AS p, lead(l_extendedprice) OVER w AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_suppkey)),
    won AS (SELECT CASE WHEN p > q THEN a ELSE b END AS winner, CASE WHEN p > q THEN b ELSE a END AS loser FROM g WHERE p <> q AND a <> b),
    names AS (SELECT item, row_number() OVER (ORDER BY item) AS i FROM (SELECT winner AS item FROM won UNION SELECT loser FROM won)),
    pairs AS (SELECT x.i, y.i AS j, sum(w) AS w, count(*) AS n FROM (SELECT winner AS one, loser AS two, 1 AS w FROM won UNION ALL SELECT loser, winner, 0 FROM won) JOIN names x ON x.item = one JOIN names y ON y.item = two GROUP BY 1, 2),
    s(step, ps) AS (SELECT 0, list(1.0::DOUBLE ORDER BY i) FROM names
      UNION ALL SELECT step, list(raw / mean ORDER BY i) FROM (
        SELECT step, i, raw, avg(raw) OVER (PARTITION BY step) AS mean FROM (SELECT step + 1 AS step, i, sum(w) / sum(n / (ps[i] + ps[j])) AS raw FROM s, pairs WHERE step < 12 GROUP BY step, i)) GROUP BY step)
    SELECT item, round(ps[i], 6) AS strength, round(CASE WHEN ps[i] BETWEEN 0 AND 1 THEN ps[i] ELSE 1 / (1 + exp(-ps[i])) END, 6) AS score FROM s, names WHERE step = 12""",
)
def preference_strengths(t: Tables):
    """Of neighbouring lines of an order the dearer one's supplier group wins."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_suppkey")  # an order has a handful of lines
    a, p = F.col("l_suppkey") % 40, F.col("l_extendedprice")
    games = t.lineitem.select(a.alias("a"), F.lead(a).over(w).alias("b"), p.alias("p"), F.lead(p).over(w).alias("q")).filter("p <> q AND a <> b")
    first = F.col("p") > F.col("q")
    wins = games.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser"))
    found = ml.bradley_terry(wins.groupBy("winner", "loser").agg(F.count(F.lit(1)).alias("n")), 12)
    return found.select("item", F.round("strength", 6).alias("strength"), F.round(ml.unit_interval(F.col("strength")), 6).alias("score"))


@query(
    "batch_embedding",
    "E5",
    """SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, round(l_quantity / 50 + l_discount, 5) AS first, round(l_quantity / 50 - l_discount, 5) AS second FROM lineitem""",
)
def batch_embedding(t: Tables):
    def make():
        import numpy as np

        def predict(q, d):
            return np.stack([q / 50 + d, q / 50 - d], axis=1)

        return predict

    out = ml.embed_rows(t.lineitem, ["l_quantity", "l_discount"], make)
    return out.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), *[F.round(F.col("embedding")[i].cast("double"), 5).alias(c) for i, c in enumerate(("first", "second"))])
