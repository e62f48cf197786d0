"""URL filtering: explicit host/path rules first, else a logistic regression on hashed character n-grams.

Everything is DataFrame and Spark ML work; judging is one narrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, let, runs

RULE_TYPE = "array<struct<size:int,host_size:int,rule:string,path:string,verdict:string>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where ``://`` is missing.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end; the path from there
    to ``?``, ``#`` or the end.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _grams(text: Column, sizes: Sequence[int], mark: str) -> Column:
    """All character n-grams of ``text`` between start and end signs, each with a mark of its field."""
    def cut(chars: Column) -> Column:
        n = F.size(chars)
        return F.concat(*[runs(n - (k - 1), "string", lambda i, k=k: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, k), ""))) for k in sizes])

    return let(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), cut)


def url_grams(host: Column, path: Column, sizes: Sequence[int] = (3, 4, 5)) -> Column:
    return F.concat(_grams(host, sizes, "h"), _grams(path, sizes, "p"))


def fit_url_model(labelled: DataFrame, url: str = "url", label: str = "blocked", buckets: int = 1 << 16, max_rows: int = 10_000, iterations: int = 40) -> PipelineModel:
    """Fits the classifier on at most ``max_rows`` labelled URLs (the bound of the sample, by hash of the URL).

    Rows with a null label are left out. ``label`` is 1 for URLs to block. The driver holds a few
    vectors of ``buckets`` doubles; every iteration sends one to the executors.
    """
    host, path = host_and_path(F.col(url))
    rows = (
        labelled.filter(F.col(label).isNotNull())
        .select(F.col(url), F.col(label).cast("double").alias("__label"), host.alias("__host"), path.alias("__path"))
        .orderBy(F.xxhash64(url), url)
        .limit(max_rows)
        .select("__label", url_grams(F.col("__host"), F.col("__path")).alias("__grams"))
    )
    tf = HashingTF(numFeatures=buckets, binary=True, inputCol="__grams", outputCol="__features")
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", probabilityCol="__probability", predictionCol="__prediction", rawPredictionCol="__raw", regParam=0.0003, maxIter=iterations, standardization=False)
    return PipelineModel([tf, lr.fit(tf.transform(rows))])


def _rule_table(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rules as a literal map host -> rules of that host."""
    hosts: dict[str, list[Column]] = {}
    for verdict, host, path in rules:
        row = F.struct(F.lit(len(host) + len(path)).alias("size"), F.lit(len(host)).alias("host_size"), F.lit(host + path).alias("rule"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict"))
        hosts.setdefault(host, []).append(row)
    if not hosts:
        return F.from_json(F.lit("{}"), f"map<string,{RULE_TYPE}>")
    return F.create_map(*[c for h, rows in hosts.items() for c in (F.lit(h), F.array(*rows).cast(RULE_TYPE))])


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule ``(verdict, host, path)`` that fits, or null.

    A rule fits its host and all its subdomains where the path starts with the rule's path. Of
    equally long rules the one with the longer host wins, then the greater rule string.
    """
    table = _rule_table(rules)
    suffixes = let(F.split(host, r"\."), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    known = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast(RULE_TYPE))))
    return F.array_max(F.filter(known, lambda r: F.startswith(path, r["path"])))


def judge_urls(pages: DataFrame, model: PipelineModel, rules: Sequence[tuple[str, str, str]] = (), url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds ``host, path, rule, verdict, score`` to every row (replacing columns of these names).

    ``verdict`` is the longest fitting rule's, else ``block`` from the model's score (probability
    of "block") on, else ``allow``. Null, empty and malformed URLs have an empty host and path,
    fit no rule and are judged by the model like any other text. Every n-gram of a long URL counts,
    however long it is. Repeated rows are judged alike,
    an empty table gives an empty result.
    """
    made = ("host", "path", "rule", "verdict", "score")
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in made]
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__rule", longest_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("__grams", url_grams(F.col("host"), F.col("path")))
    score = vector_to_array("__probability")[1]
    by_model = F.when(score >= threshold, "block").otherwise("allow")
    return model.transform(rows).select(
        *kept, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), by_model).alias("verdict"), score.alias("score")
    )
