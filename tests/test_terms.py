"""Vocabulary, vectors and scores of the text classifier against plain counting and Spark's own vectoriser."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tickloom.operators import ml, terms


def made(seed: int, n: int = 60):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30).clip(max=60)) for _ in range(n)]
    return [(i, t, int(rng.random() < 0.2 + 0.6 * ("w4" in t.split()))) for i, t in enumerate(texts)] + [(n, "W1, İw2 Kw2 a w1éw3-w1_w1", 1), (n + 1, "", 0)]


def counted(texts, min_df):
    n, df = Counter(), Counter()
    for t in texts:
        w = [x for x in re.split(r"[^a-zA-Z0-9_]+", t.lower()) if len(x) > 1]
        each = Counter([*[(x,) for x in w], *zip(w, w[1:], strict=False)])
        n.update(each)
        df.update(each.keys())
    return {t: c for t, c in n.items() if df[t] >= min_df}


@pytest.mark.parametrize(("most", "min_df"), [(7, 2), (25, 3), (40, 1), (5000, 2)])
def test_vocabulary_equals_plain_counting(spark, most, min_df):
    rows = made(1)
    frame = spark.createDataFrame(rows, "k long, text string, y int").withColumn("text", F.col("text").cast("binary")).repartition(5, "k")
    want = counted([t for _, t, _ in rows], min_df)
    words = terms.frequent_words(frame, "text", min_df, most)
    names = [*words]
    coded = terms.word_codes(frame, "text", "w", names)
    found = terms.frequent_terms(coded, "w", words, min_df, most)
    as_term = [(names[c],) if c < len(names) else (names[(c - len(names)) // len(names)], names[(c - len(names)) % len(names)]) for c in found]
    assert as_term == sorted(want, key=lambda t: (-want[t], len(t), t))[:most]
    for r in terms.term_vectors(coded, "w", "v", len(names), found).collect():
        here = counted([rows[r["k"]][1]], 1)
        assert r["v"].size == len(found) and [*r["v"].toArray()] == [here.get(t, 0) for t in as_term]


def test_text_classifier_equals_the_vectoriser(spark):
    frame = spark.createDataFrame(made(2), "k long, text string, y int")
    train, test = frame.filter("k % 3 > 0"), frame.filter("k % 3 = 0")
    got = {r["k"]: (r["score"], r["guess"]) for r in ml.text_classifier(train, test, "text", "y").collect()}
    share = train.agg(F.avg("y")).first()[0]
    plain = Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\W+", minTokenLength=2),
            NGram(n=2, inputCol="w", outputCol="b"),
            SQLTransformer(statement="SELECT *, concat(w, b) AS t FROM __THIS__"),
            CountVectorizer(inputCol="t", outputCol="c", minDF=2.0, vocabSize=5000),
            IDF(inputCol="c", outputCol="f"),
            LogisticRegression(featuresCol="f", labelCol="y", weightCol="weight", regParam=1e-2, maxIter=30),
        ]
    ).fit(train.withColumn("weight", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share))))
    want = {r["k"]: (r["s"], r["prediction"]) for r in plain.transform(test).withColumn("s", vector_to_array("probability")[1]).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1] == want[k][1] for k in want)


def test_equally_frequent_terms_do_not_depend_on_partitions(spark):
    rows = [(i, f"x{i % 20} y{i % 20} x{i % 20}", i % 20 % 2) for i in range(80)]  # all words of x are equally frequent, so are all of y
    frame = spark.createDataFrame(rows, "k long, text string, y int")
    scores = []
    for parts in (1, 3, 7):
        train = frame.repartition(parts, "k")
        got = ml.text_classifier(train, frame, "text", "y", terms=9).collect()
        scores.append([r["score"] for r in sorted(got, key=lambda r: r["k"])])
    assert np.allclose(scores[0], scores[1]) and np.allclose(scores[0], scores[2])
    known = {0, 1, 10, 11, 12, 13, 14, 15, 16}  # the first nine of x0 to x19 in alphabetical order
    other = scores[0][2]
    assert {i % 20 for i in range(80) if abs(scores[0][i] - other) > 1e-6} == known
