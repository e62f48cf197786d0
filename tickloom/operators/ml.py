"""Probes and preference models as ordinary Spark ML jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.metrics import auc
from tickloom.operators.ordered import join_on
from tickloom.operators.splits import nested_subset
from tickloom.operators.terms import frequent_terms, frequent_words, term_vectors, word_codes
from tickloom.session import cut_lineage, stored


def as_vector(rows: DataFrame, vector: str, name: str = "features") -> DataFrame:
    return rows.withColumn(name, array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def _scored(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).withColumn("guess", F.col("prediction").cast("int"))


def fit_probe(train: DataFrame, test: DataFrame, vector: str, label: str, reg: float = 1e-3, iterations: int = 50) -> DataFrame:
    """Logistic probe on features standardised on the training rows; the test rows with ``score`` and ``guess``."""
    stages = [
        StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True),
        LogisticRegression(featuresCol="__z", labelCol=label, regParam=reg, maxIter=iterations),
    ]
    model = Pipeline(stages=stages).fit(as_vector(train, vector, "__x"))
    return _scored(model, as_vector(test, vector, "__x")).drop("__x", "__z", "rawPrediction", "probability", "prediction")


def probe_report(scored: DataFrame, label: str, buckets: Sequence[str] = ()) -> DataFrame:
    """Rows, accuracy, majority share, lift and AUC overall or per bucket."""
    group = list(buckets) or ["__g"]
    rows = scored if buckets else scored.withColumn("__g", F.when(F.col("score").isNull(), 1).otherwise(0))
    share = F.avg(F.col(label).cast("double"))
    g = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("guess") == F.col(label)).cast("double")).alias("accuracy"), F.greatest(share, 1 - share).alias("majority"))
    g = g.withColumn("lift", F.col("accuracy") - F.col("majority"))
    return join_on(g, auc(rows, group, "score", label).select(*group, "auc"), group, "left").drop("__g")


def multi_probe(train: DataFrame, test: DataFrame, vector: str, targets: Sequence[str]) -> DataFrame:
    """One probe per binary target, reported side by side (one fit per target)."""
    parts = [probe_report(fit_probe(train, test, vector, t), t).withColumn("target", F.lit(t)) for t in targets]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def learning_curve(train: DataFrame, test: DataFrame, vector: str, label: str, group: str, sizes: Sequence[int], seed: int = 0) -> DataFrame:
    """Probe quality on nested subsets of the training groups."""
    out = None
    for n in sizes:
        part = probe_report(fit_probe(nested_subset(train, group, n, seed), test, vector, label), label).withColumn("groups", F.lit(n).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def ablation_table(train: DataFrame, test: DataFrame, vector: str, label: str, size: int, presets: dict[str, Sequence[int]]) -> DataFrame:
    """Probe quality with groups of vector positions set to zero."""
    out = None
    for name, zero in presets.items():
        off = set(zero)
        kept = F.array(*[F.lit(0.0) if i in off else F.col(vector)[i].cast("double") for i in range(size)])
        part = probe_report(fit_probe(train.withColumn("__v", kept), test.withColumn("__v", kept), "__v", label), label).withColumn("preset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def text_classifier(train: DataFrame, test: DataFrame, text: str, label: str, min_df: int = 2, terms: int = 5000, reg: float = 1e-2) -> DataFrame:
    """TF-IDF of words and word pairs with class-balanced logistic regression: the test rows, without their text, with ``score`` and ``guess``.

    The vocabulary is the ``terms`` most frequent words and pairs of at least ``min_df`` training texts; of equally frequent ones words come
    first, then alphabetical order decides.
    """
    train, test = (r.withColumn(text, F.col(text).cast("binary")) for r in (train, test))
    train = stored(train, "texts")
    share = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    weight = F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    words = frequent_words(train, text, min_df, terms)
    if not words:
        raise ValueError(f"no word is in {min_df} texts")
    train, test = (stored(word_codes(r, text, "__w", [*words]), "words") for r in (train.withColumn("__weight", weight), test.withColumn("__weight", F.lit(1.0))))
    vocabulary = frequent_terms(train, "__w", words, min_df, terms)
    train, test = (term_vectors(r, "__w", "__c", len(words), vocabulary) for r in (train, test))
    learn = Pipeline(stages=[IDF(inputCol="__c", outputCol="__f"), LogisticRegression(featuresCol="__f", labelCol=label, weightCol="__weight", regParam=reg, maxIter=30)])
    scored = _scored(learn.fit(train), test)
    return stored(scored.drop("__c", "__f", "__weight", "rawPrediction", "probability", "prediction"), "scores")


def preference_model(pairs: DataFrame, chosen: str, rejected: str, reg: float = 1e-3):
    """Bradley-Terry weights: logistic regression without intercept on feature differences, both ways round."""

    def diff(a, b, y):
        d = F.zip_with(a, b, lambda x, z: x.cast("double") - z.cast("double"))
        return pairs.select(array_to_vector(d).alias("features"), F.lit(float(y)).alias("label"))

    both = diff(chosen, rejected, 1).unionByName(diff(rejected, chosen, 0))
    return LogisticRegression(fitIntercept=False, regParam=reg, maxIter=50).fit(both)


def preference_score(model, rows: DataFrame, vector: str, name: str = "score") -> DataFrame:
    """Utility of each row under a preference model (a dot product, no UDF)."""
    w = F.array(*[F.lit(float(x)) for x in model.coefficients])
    products = F.zip_with(F.col(vector), w, lambda x, y: x.cast("double") * y)
    return rows.withColumn(name, F.aggregate(products, F.lit(0.0), lambda a, x: a + x))


def variance_components(rows: DataFrame, vector: str, size: int, levels: Sequence[float] = (0.9, 0.95, 0.99)) -> DataFrame:
    """How many principal components reach each share of the variance."""
    model = PCA(k=size, inputCol="features", outputCol="pc").fit(as_vector(rows, vector))
    shares = [float(x) for x in model.explainedVariance]  # one number per component
    spark = rows.sparkSession
    table = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in shares])).alias("i", "share"))
    sums = table.withColumn("cum", F.aggregate(F.slice(F.array(*[F.lit(s) for s in shares]), F.lit(1), F.col("i") + 1), F.lit(0.0), lambda a, x: a + x))
    picks = F.array(*[F.struct(F.lit(v).alias("level"), F.min(F.when(F.col("cum") >= v - 1e-12, F.col("i") + 1)).cast("long").alias("k")) for v in levels])
    return sums.agg(picks.alias("p")).select(F.inline("p"))


def lloyd(rows: DataFrame, key: str, vector: str, codes: int, rounds: int) -> list[list[float]]:
    """Centres of a codebook after ``rounds`` Lloyd steps.

    The first centres are the rows whose keys have the least MD5 sums (of equal keys the least vectors). A step is one aggregation; the
    driver holds the centres. A code that no row takes keeps its centre.
    """
    first = rows.select(vector, key).orderBy(F.md5(F.col(key).cast("string")), key, vector).limit(codes).collect()  # `codes` rows
    centres = [[float(x) for x in r[vector]] for r in first]
    for _ in range(rounds):
        sums = [F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"c{i}") for i in range(len(centres[0]) if centres else 0)]
        if not sums:
            break
        for r in rows.withColumn("code", nearest_code(F.col(vector), centres)).groupBy("code").agg(*sums).collect():
            centres[r["code"]] = [r[f"c{i}"] for i in range(len(sums))]
    return centres


def _squared(vector: Column, centre: Column) -> Column:
    return F.aggregate(F.zip_with(vector, centre, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)


def nearest_code(vector: Column, centres: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centre, of equally near ones the least."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    ranked = F.transform(table, lambda c, i: F.struct(_squared(vector, c).alias("d"), i.alias("code")))
    return F.array_min(ranked)["code"]


def codebook_report(rows: DataFrame, key: str, vector: str, codes: int, by: Sequence[str], rounds: int = 8) -> DataFrame:
    """Reconstruction error per group and how many codes are used, for a codebook of ``lloyd``."""
    centres = lloyd(rows, key, vector, codes, rounds)
    table = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])
    coded = rows.withColumn("code", nearest_code(F.col(vector), centres))
    coded = coded.withColumn("err", _squared(F.col(vector), F.element_at(table, F.col("code") + 1)))
    return coded.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("err")).alias("rmse"), F.count_distinct("code").alias("codes_used"))


def bradley_terry(wins: DataFrame, rounds: int = 20) -> DataFrame:
    """``item, strength`` after ``rounds`` minorise-maximise steps over ``winner, loser, n``.

    Every step sets an item's strength to its wins over the sum of ``games / (own + other's strength)``, then
    scales all to a mean of 1. Pairs of an item with itself are left out, items without a win have strength 0.
    """
    played = wins.filter("winner <> loser").groupBy("winner", "loser").agg(F.sum("n").alias("n"))
    both = played.select(F.col("winner").alias("item"), F.col("loser").alias("other"), F.col("n").alias("won"), "n")
    both = both.unionByName(played.select(F.col("loser").alias("item"), F.col("winner").alias("other"), F.lit(0).cast("long").alias("won"), "n"))
    games = cut_lineage(both.groupBy("item", "other").agg(F.sum("won").alias("won"), F.sum("n").alias("n")))
    strengths = games.select("item").distinct().withColumn("strength", F.lit(1.0))
    for _ in range(rounds):
        own, theirs = strengths.select("item", "strength"), strengths.select(F.col("item").alias("other"), F.col("strength").alias("against"))
        met = games.join(own, "item").join(theirs, "other")
        step = met.groupBy("item").agg((F.sum("won") / F.sum(F.try_divide(F.col("n"), F.col("strength") + F.col("against")))).alias("raw"))
        scale = step.agg(F.avg("raw").alias("mean"))
        strengths = cut_lineage(step.crossJoin(scale).select("item", F.coalesce(F.try_divide("raw", "mean"), F.lit(0.0)).alias("strength")))  # one row
    return strengths


def unit_interval(score: Column) -> Column:
    """A score in [0, 1] as it is, any other through the logistic function."""
    x = score.cast("double")
    return F.when(x.between(0.0, 1.0), x).otherwise(1 / (1 + F.exp(-x)))


def embed_rows(rows: DataFrame, columns: Sequence[str], make_predict: Callable, name: str = "embedding", batch: int = 1024) -> DataFrame:
    """Embeds rows in Arrow batches with a user's model, built once per worker by ``make_predict``."""
    from pyspark.sql.types import ArrayType, FloatType

    run = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch)
    return rows.withColumn(name, run(*[F.col(c) for c in columns]))


def assemble(rows: DataFrame, columns: Sequence[str], name: str = "vector") -> DataFrame:
    """Numeric columns as one array column for the probes."""
    out = VectorAssembler(inputCols=list(columns), outputCol="__a", handleInvalid="keep").transform(rows)
    return out.withColumn(name, vector_to_array("__a")).drop("__a")
