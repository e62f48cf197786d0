"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

A file's own licence is the template nearest to one of its sentences (a header may stand anywhere
in the file) or, in a licence file, to the whole text. A file without one takes the licence of the
licence file in its nearest ancestor directory. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, let, staged

TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
SENTENCES = r"[\r\n]+|(?<=[.;!?])\s+"
LICENCE_FILE = r"(?i)^(licen[cs]es?|copying|unlicen[cs]e|notice)([._-].*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def directory(path: Column) -> Column:
    """Everything before the last slash (without one: empty)."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def document_frequencies(files: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """How many files there are, and in how many each term of the templates occurs: all files count.

    The driver gets one row per term of the templates.
    """
    known = F.array(*[F.lit(v) for v in vocabulary])
    counted = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(known, terms(F.col(text))))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}
    return found.get("", 0), {v: found.get(v, 0) for v in vocabulary}


class Templates:
    """Licence templates with the TF-IDF weights of their terms, scaled to length one."""

    def __init__(self, templates: list[tuple[str, str]], n_files: int, frequency: dict[str, int]):
        self.n_files = n_files
        self.idf = {t: math.log((1 + n_files) / (1 + n)) + 1 for t, n in frequency.items()}
        self.unseen = math.log(1 + n_files) + 1  # of terms outside the templates
        self.vectors: list[tuple[str, dict[str, float]]] = []
        for name, text in templates:
            raw = {t: c * self.idf[t] for t, c in Counter(re.findall(TERM, text.lower())).items()}
            size = math.sqrt(sum(w * w for w in raw.values())) or 1.0
            self.vectors.append((name, {t: w / size for t, w in raw.items()}))

    @staticmethod
    def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
        return sorted({t for _, text in templates for t in re.findall(TERM, text.lower())})

    def cues(self, threshold: float) -> list[str]:
        """Terms one of which every text has whose cosine to some template reaches the threshold.

        Without its heaviest terms a template keeps a part shorter than the threshold, and no
        cosine exceeds the length of the part that a text can meet.
        """
        needed: set[str] = set()
        for _, vector in self.vectors:
            rest = sum(w * w for w in vector.values())
            for term in sorted(vector, key=lambda t: (-vector[t], t)):
                if rest < threshold * threshold * 0.999:
                    break
                needed.add(term)
                rest -= vector[term] ** 2
        return sorted(needed)

    def weights(self, spark) -> DataFrame:
        """Rows ``term, template, weight``; as many as the templates have distinct terms."""
        rows = ", ".join(f"('{t}', '{name}', {number}, CAST({w!r} AS DOUBLE))" for number, (name, v) in enumerate(self.vectors) for t, w in sorted(v.items()))
        return spark.sql(f"SELECT * FROM VALUES {rows} AS weights(term, licence, template, weight)")

    def idf_of(self, term: Column) -> Column:
        table = F.create_map(*[F.lit(x) for t, v in sorted(self.idf.items()) for x in (t, v)])
        return F.coalesce(F.try_element_at(table, term), F.lit(self.unseen))


def own_licence(files: DataFrame, templates: Templates, threshold: float = 0.6) -> DataFrame:
    """``row_id, licence, score`` of the files whose best cosine to a template reaches the threshold.

    ``files`` has ``row_id, path, text``. Equal scores go to the lesser licence name. Scores are
    rounded to six digits. Repeated rows of one file make its counts greater, not its cosines.
    """
    spark = files.sparkSession
    is_licence = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE)
    cue = F.array(*[F.lit(c) for c in templates.cues(threshold)])
    pieces = F.transform(F.split(F.coalesce("text", F.lit("")), SENTENCES), lambda s, i: F.struct(i.alias("piece"), terms(s).alias("terms")))
    pieces = F.concat(pieces, F.when(is_licence, F.array(F.struct(F.lit(-1).alias("piece"), terms(F.col("text")).alias("terms")))).otherwise(F.array().cast("array<struct<piece:int,terms:array<string>>>")))
    telling = F.filter(pieces, lambda p: F.arrays_overlap(p["terms"], cue))
    piece = files.select("row_id", F.explode(telling).alias("p")).select("row_id", "p.piece", F.explode("p.terms").alias("term"))
    counted = piece.groupBy("row_id", "piece", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = staged(counted, "licence-terms")  # sentences are cut once for sizes and products
    counted = counted.withColumn("value", F.col("tf") * templates.idf_of(F.col("term")))
    sizes = counted.groupBy("row_id", "piece").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
    dots = counted.join(templates.weights(spark), "term").groupBy("row_id", "piece", "licence", "template").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    scored = dots.join(sizes, ["row_id", "piece"]).withColumn("score", F.round(F.col("dot") / F.col("size"), 6)).filter(F.col("score") >= threshold)
    best = scored.groupBy("row_id").agg(F.min(F.struct((-F.col("score")).alias("order"), "licence")).alias("x"))
    return best.select("row_id", F.col("x.licence").alias("licence"), (-F.col("x.order")).alias("score"))


def inherited(dirs: DataFrame, licensed: DataFrame) -> DataFrame:
    """``dir, licence, origin`` for every directory: the licence of itself or its nearest ancestor.

    ``licensed`` has one licence per directory. Each distinct directory is joined with its
    ancestors (itself and each shorter path; the empty path is the root) and takes the longest match.
    """
    steps = F.split("dir", "/")
    parents = let(steps, lambda s: F.transform(F.sequence(F.lit(0), F.size(s)), lambda n: F.array_join(F.slice(s, F.lit(1), n), "/")))
    chain = dirs.select("dir", F.explode(F.array_distinct(parents)).alias("ancestor"))
    found = chain.join(licensed.withColumnRenamed("dir", "ancestor"), "ancestor")
    nearest = found.groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "licence")).alias("x"))
    return nearest.select("dir", F.col("x.licence").alias("licence"), F.col("x.ancestor").alias("origin"))


def scan(files: DataFrame, templates: list[tuple[str, str]], path: str = "path", text: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.6) -> DataFrame:
    """One row per file: ``keep``'s columns, ``path, licence, score, how, origin``.

    ``how`` is ``own``, ``inherited`` (``origin`` has the directory) or ``none``. A directory with several
    licence files takes the one with the best score, of equal ones the lesser licence. Null
    paths are files in the root, null or empty texts have no licence of their own; every sentence of
    a long text counts; an empty table gives none. A file is known by path and text, whatever order the rows
    come in: rows repeated under both have the same licence. Columns of ``keep`` that are named
    like one of the result's are left out.
    """
    keep = tuple(c for c in keep if c not in ("path", "licence", "score", "how", "origin"))
    kept = [F.col(c) for c in keep]
    at = F.coalesce(F.col(path), F.lit(""))
    name = F.struct(F.xxhash64(at, text).alias("a"), F.xxhash64(F.lit("file"), text, at).alias("b"))
    rows = files.select(name.alias("row_id"), at.alias("path"), F.col(text).alias("text"), *[c.alias(f"kept_{i}") for i, c in enumerate(kept)])
    n, frequency = document_frequencies(rows, Templates.vocabulary(templates))
    model = Templates(templates, n, frequency)
    own = staged(own_licence(rows, model, threshold), "licences")
    named = rows.drop("text").join(own, "row_id", "left").withColumn("dir", directory(F.col("path")))
    of_dir = named.filter(F.col("licence").isNotNull() & F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE))
    of_dir = of_dir.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("order"), "licence")).alias("x")).select("dir", F.col("x.licence").alias("licence"))
    by_dir = inherited(named.select("dir").distinct(), of_dir).withColumnRenamed("licence", "from_dir")
    out = named.join(by_dir, "dir", "left")
    how = F.when(F.col("licence").isNotNull(), "own").when(F.col("from_dir").isNotNull(), "inherited").otherwise("none")
    return out.select(
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], "path", F.coalesce("licence", "from_dir").alias("licence"), "score", how.alias("how"),
        F.when(F.col("licence").isNull(), F.col("origin")).alias("origin"),
    )
