"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword. One binary classifier per bit (log-likelihood ratios of hashed
n-grams of the languages with that bit set against the others) predicts the bits of a text;
the codeword with the least weighted loss wins, and a close second marks the text ambiguous.

The counts behind the classifiers come from a Spark aggregation over a bounded sample of
labelled rows; prediction is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import tidy
from tickloom.llm.encode import chunks

UNKNOWN = "und"
CHUNK = 1 << 20  # bytes of text decoded at a time; the n-gram arrays take about 25 times as much
GRAMS = 1 << 16  # buckets of each n-gram size: all byte pairs, hashed byte triples
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[i for i in range(128) if not chr(i).isalpha()]] = 32


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of +-1 per language. Up to five languages get the exhaustive code, more get the best
    of several random codes with about ten bits per doubling."""
    if languages < 2:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= 5:
        columns = range((1 << (languages - 1)) - 1)
        return np.array([[1 if (c << 1 | 1) >> k & 1 else -1 for c in columns] for k in range(languages)], dtype=np.int8)
    rng, best, best_gap = np.random.default_rng(seed), None, -1
    bits = max(15, int(np.ceil(10 * np.log2(languages))))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(languages, bits))
        product = code.astype(int) @ code.T
        gap = int((bits - product[~np.eye(languages, dtype=bool)]).min()) // 2
        if gap > best_gap and (np.abs(code.sum(axis=0)) < languages).all():
            best, best_gap = code, gap
    return best


def gram_codes(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Byte n-gram codes of all texts in one run, and where each text starts and ends.

    Texts are lower-cased, everything in ASCII that isn't a letter becomes a space; every text is
    set between spaces. Code 0 marks what is no n-gram of one text or only spaces.
    """
    space = pa.scalar(" ", pa.large_string())
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    low = pc.binary_join_element_wise(space, low, space, pa.scalar("", pa.large_string()))
    low = pa.concat_arrays([low])
    ends = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
    raw = _BLANK[np.frombuffer(low.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    bounds = ends - ends[0]
    wide = raw.astype(np.uint32)
    two = np.zeros(len(raw), np.uint32)
    two[:-1] = wide[:-1] << 8 | wide[1:]
    three = np.zeros(len(raw), np.uint32)
    three[:-2] = (((two[:-2] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(16)) & np.uint32(GRAMS - 1)
    blank = raw == 32
    nothing = np.zeros(len(raw), bool)
    nothing[:-1] = blank[:-1] & blank[1:]
    nothing[bounds[1:] - 1] = True
    two[nothing] = 0
    nothing[bounds[1:] - 2] = True
    nothing[:-2] |= blank[:-2] & blank[1:-1] & blank[2:]
    three[nothing] = 0
    return raw, [two, three], bounds


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # (languages, bits) of +-1
    weights: np.ndarray  # (n-gram sizes, bits, GRAMS) float32; margins of a typical text are near +-1
    reliability: np.ndarray  # weight of each bit's loss

    @classmethod
    def from_counts(cls, languages: list[str], counts: np.ndarray, smooth: float = 0.5) -> LanguageModel:
        """``counts``: (languages, n-gram sizes, GRAMS)."""
        code = codewords(len(languages))
        if len(languages) < 2:
            return cls(tuple(languages), code, np.zeros((counts.shape[1] if len(languages) else 2, 1, GRAMS), np.float32), np.ones(1))
        p = (counts + smooth) / (counts + smooth).sum(axis=2, keepdims=True)
        weights, expected = [], []
        for bit in code.T:
            ratio = np.log(p[bit > 0].mean(axis=0)) - np.log(p[bit < 0].mean(axis=0))
            ratio[:, 0] = 0
            mean = (p * ratio).sum(axis=(1, 2)) * bit  # expected margin of each language, towards its own side
            scale = max(float(np.abs(mean).mean()), 1e-9)
            weights.append(ratio / scale)
            expected.append(mean / scale)
        reliability = np.clip(np.min(expected, axis=1), 0.05, 1.0)
        return cls(tuple(languages), code, np.transpose(np.array(weights, np.float32), (1, 0, 2)).copy(), reliability / reliability.mean())

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Mean evidence per n-gram for every bit: (texts, bits)."""
        _, codes, bounds = gram_codes(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        for table, code in zip(self.weights, codes):
            seen = np.add.reduceat((code > 0).astype(np.float32), bounds[:-1])
            for b in range(out.shape[1]):
                out[:, b] += np.add.reduceat(table[b][code], bounds[:-1], dtype=np.float64) / np.maximum(seen, 1)
        return out

    def decode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (index), the score of it (0 to 1) and its lead over the second."""
        margin = self.margins(texts)
        loss = np.stack([(np.logaddexp(0, -2 * margin * word) * self.reliability).sum(axis=1) for word in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        rank = np.sort(share, axis=1)
        return best, rank[:, -1], rank[:, -1] - (rank[:, -2] if rank.shape[1] > 1 else 0)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for some in chunks(batch, size=CHUNK):
            _, codes, bounds = gram_codes(some.column("text"))
            names = some.column("lang").dictionary_encode()
            of = np.repeat(names.indices.to_numpy(), np.diff(bounds))
            for k, name in enumerate(names.dictionary.to_pylist()):
                mine = of == k
                total.setdefault(name, np.zeros((len(codes), GRAMS), np.int64))
                for size, code in enumerate(codes):
                    total[name][size] += np.bincount(code[mine], minlength=GRAMS)
    for name, table in total.items():
        table[:, 0] = 0
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table.ravel()[at])], names=["lang", "gram", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 2000) -> LanguageModel:
    """Learns from a sample of the rows with a text and a language.

    ``per_language`` bounds the sample: a language with more rows gives the share of them, by a hash of
    ``key`` and text, that makes this many on average. Counts are added up in Spark; the driver gets at
    most one row per language and n-gram bucket. Without labelled rows the model knows no
    language.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel.from_counts([], np.zeros((0, 2, GRAMS)))
    steps = 1 << 40
    keep = F.lit(0).cast("long")
    for name, n in sorted(sizes.items()):
        keep = F.when(F.col("lang") == name, F.lit(min(steps, steps * per_language // n))).otherwise(keep)
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "key", "text"), F.lit(steps)) < keep)
    counted = sample.select("text", "lang").mapInArrow(tidy("langid", _counter), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted.column("lang").to_pylist()))
    counts = np.zeros((len(languages), 2 * GRAMS))
    place = np.searchsorted(np.array(languages), counted.column("lang").to_numpy())
    counts[place, counted.column("gram").to_numpy()] = counted.column("n").to_numpy()
    return LanguageModel.from_counts(languages, counts.reshape(len(languages), 2, GRAMS))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, ambiguous_below: float = 0.1) -> DataFrame:
    """Adds ``lang_pred, score, ambiguous`` to the columns of ``keep`` (default: all).

    Only the text is looked at. Null texts and texts without a letter are ``und`` with score 0 and
    not ambiguous, and so is everything where the model knows no language. A text is ambiguous
    where the best language leads the second by less than ``ambiguous_below``. Columns of these
    names are replaced; repeated rows are judged alike.
    """
    made = ("lang_pred", "score", "ambiguous")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    carried = text in kept  # the text travels once
    rows = docs.select(*kept) if carried else docs.select(*kept, F.col(text).alias("__text"))
    name = text if carried else "__text"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, UNKNOWN])
        for batch in batches:
            for some in chunks(batch, name, CHUNK):
                texts = some.column(name)
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if model.languages:
                    best, score, lead = model.decode(texts)
                else:
                    best, score, lead = (np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts)))
                    lettered[:] = False
                best = np.where(lettered, best, len(model.languages))
                made = [names.take(pa.array(best)), pa.array(np.where(lettered, score, 0.0)), pa.array(lettered & (lead < ambiguous_below))]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], *made], names=[*kept, "lang_pred", "score", "ambiguous"])

    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return rows.mapInArrow(tidy("langid", judge), schema)
