"""Language identification with a string kernel.

Kernel: the blended spectrum of presence bits. A text is the set of its letter n-grams of 1 to
``LONGEST`` characters (lower-cased; each run of non-letters is one space), hashed into ``BUCKETS``;
the kernel of two texts is the number of common n-grams over the square root of the product of
their numbers. Nyström: the kernel is approximated through landmarks, some labelled texts. Kernel
ridge regression, one language against the rest, is solved in the landmarks' space. Since the
kernel with a landmark is a sum over n-grams, landmarks and coefficients fold into one weight per
n-gram and language, and a batch of texts is scored by one matrix product.

Training uses a bounded sample of labelled rows, the parameters of ``Sample``; every document is
scored by its whole text. The model (at most ``Sample.weights`` weights) is broadcast.

Rows whose CRC-32 of the doc_id as text leaves remainder 0 by 5 are held out of training.

Defined cases. Null text or one without letters: ``und``, score 0. Null doc_id: taken as the empty
text, so held out. Null lang: not learned from. No labelled rows: all ``und``. One language: all
texts with letters are of it. Ties between languages: the first in the order of code points. Repeated
rows: each is scored alike. Very long texts: all characters count, in memory of some 30 bytes a character. An empty table: an empty result. Further columns are
kept; of columns named like a result column, the result's value stays.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.llm.common import table, written

LONGEST = 3
BUCKETS = 1 << 18
FOLDS = 5
UNKNOWN = "und"
RESULT = ("held_out", "lang_pred", "score")


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: rows and characters a language, and rows in all. Rows are those with
    the smallest hash, whole, of any length: a language's rows end with the one that reaches
    ``chars_a_language``. The first ``landmarks`` rows, languages in turn, are landmarks, or as many
    of them as keep the model within ``weights``."""

    rows_a_language: int = 400
    chars_a_language: int = 1_000_000
    rows: int = 4000
    landmarks: int = 128
    weights: int = 1 << 25
    ridge: float = 1e-3


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, that of its lower-case letter, or a space."""
    found = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            found[k] = ord(low) if len(low) == 1 else k
    return found


def grams(text: str | None) -> np.ndarray:
    """The distinct buckets of the text's n-grams, ascending; none without letters."""
    codes = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == 32
    if space.all():
        return np.empty(0, np.int64)
    keep = ~space
    keep[1:] |= ~space[:-1]
    codes = codes[keep]
    seen, hashed = np.zeros(BUCKETS, bool), np.zeros(len(codes), np.uint32)
    for n in range(LONGEST):
        hashed = (hashed[: len(codes) - n] * np.uint32(0x9E3779B1)) ^ (codes[n:] * np.uint32(0x85EBCA6B) + np.uint32(n))
        seen[(hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(14)] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    column: np.ndarray  # of each bucket that a landmark has, else -1
    weights: np.ndarray  # columns by languages

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        """The regressions' values for each set of buckets."""
        have = np.zeros((len(sets), len(self.weights)), np.float32)
        for row, own in zip(have, sets):
            column = self.column[own]
            row[column[column >= 0]] = 1
        size = np.sqrt(np.maximum(1, [len(s) for s in sets]))
        return have @ self.weights / size[:, None]


def fit(texts: list[str], langs: list[str], sample: Sample) -> Model | None:
    """texts: languages in turn. The model of the labelled texts; None if none has a letter."""
    rows = [(s, lang) for s, lang in zip(map(grams, texts), langs) if len(s)]
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    marks = [s for s, _ in rows[: sample.landmarks]]
    known = np.unique(np.concatenate(marks))
    while len(known) * len(languages) > sample.weights and len(marks) > 1:
        marks = marks[: len(marks) // 2]
        known = np.unique(np.concatenate(marks))
    column = np.full(BUCKETS, -1, np.int32)
    column[known] = np.arange(len(known))
    bits = np.zeros((len(known), len(marks)), np.float64)
    for k, own in enumerate(marks):
        bits[column[own], k] = 1 / np.sqrt(len(own))

    def kernel(sets: list[np.ndarray]) -> np.ndarray:
        return np.stack([bits[(c := column[s])[c >= 0]].sum(axis=0) / np.sqrt(len(s)) for s in sets])

    among = kernel(marks)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    used = values > 1e-8 * values[-1]
    root = vectors[:, used] / np.sqrt(values[used])
    space = kernel([s for s, _ in rows]) @ root
    wanted = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in rows])
    ridge = sample.ridge * len(rows) * np.eye(space.shape[1])
    solved = np.linalg.solve(space.T @ space + ridge, space.T @ wanted)
    return Model(languages, column, (bits @ (root @ solved)).astype(np.float32))


def train(docs: DataFrame, sample: Sample = Sample()) -> Model | None:
    """Learn from ``doc_id, text, lang`` of rows that aren't held out and have a letter."""
    able = docs.select("doc_id", "text", "lang").filter(~_held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Few more rows than wanted pass a threshold on the hash, so that the largest language's rows
    # don't meet in one task; the smallest hashes of those are taken. Only rows that can be taken count.
    counts = written(able.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_of")), "languages")
    share = F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5
    some = able.withColumn("_at", share).join(counts, F.col("lang") == F.col("_lang")).filter(F.col("_at") * F.col("_of") <= 3 * sample.rows_a_language)
    order = Window.partitionBy("lang").orderBy("_at", "doc_id")
    upto = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = some.withColumns({"nth": F.row_number().over(order), "_upto": upto}).filter((F.col("nth") <= sample.rows_a_language) & (F.col("_upto") < sample.chars_a_language))
    rows = taken.orderBy("nth", "lang").limit(sample.rows).select("text", "lang").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], sample)


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0


def identify(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred and score."""
    clash = [c for c in docs.columns if c in RESULT or c.startswith("_l_")]
    docs = docs.drop(*clash)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in parts:
            names, scores = [], []
            for at in range(0, len(texts), 64):
                sets = [grams(t) for t in texts.iloc[at : at + 64]]
                if model is None:
                    names += [UNKNOWN] * len(sets)
                    scores += [0.0] * len(sets)
                    continue
                value = np.exp(4 * np.clip(model.score(sets), -2, 2))
                best = value.argmax(axis=1)
                sure = value[np.arange(len(sets)), best] / value.sum(axis=1)
                names += [model.languages[b] if len(s) else UNKNOWN for s, b in zip(sets, best)]
                scores += [float(v) if len(s) else 0.0 for s, v in zip(sets, sure)]
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    found = docs.withColumn("held_out", _held_out()).withColumn("_l_found", predict(F.col("text")))
    return found.select(*docs.columns, "held_out", "_l_found.lang_pred", "_l_found.score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", *RESULT)


QUERY = ("op9_language_id", op9_language_id)
SQL = None
