"""Language identification with bit-sliced Bloom filters.

Every learned language has one bit.  A filter slot holds the bits of all
languages that put an n-gram there, so one look-up of an n-gram (the AND of its
slots) returns all languages that have it.  A text gives, per language, the
number of its n-grams that the language has; the number expected from false
positives at the language's fill is taken off, and the highest rest decides.

Learning counts the n-grams of all labelled rows.  A language holds an n-gram
if its rate there is at least ``FLOOR`` and at least ``SHARE`` of its highest
rate in any language.  The filter has ``SLOTS`` slots whatever the corpus, so
what is collected and broadcast has a fixed size.

Null text and text without a letter is ``und`` with score 0; so is everything
where nothing was learned.  Ties go to the first language in code-point order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import fresh

N = 3
SLOTS = 1 << 18
HASHES = 3
FLOOR = 2e-5
SHARE = 0.2
#: Code points handled at once within a task.
CHUNK = 1 << 18
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else the blank."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the texts as integers and the index of the text of each.

    Letters are lower-cased, everything else is one blank; n-grams of blanks
    only do not count.
    """
    low = [f" {t.lower()} " for t in texts]
    codes = _letters()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.uint64)
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    again = np.ones(len(codes), bool)
    again[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    codes, owner = codes[again], owner[again]
    if len(codes) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = codes[: len(codes) - N + 1].copy()
    for k in range(1, N):
        grams = (grams << np.uint64(21)) | codes[k : len(codes) - N + 1 + k]
    whole = (owner[N - 1 :] == owner[: len(owner) - N + 1])
    return grams[whole], owner[: len(owner) - N + 1][whole]


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    out = []
    for odd in _ODD[:HASHES]:
        x = (grams ^ (grams >> np.uint64(29))) * odd
        x = (x ^ (x >> np.uint64(32))) * _ODD[0]
        out.append((x >> np.uint64(40)).astype(np.int64) % SLOTS)
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) of about CHUNK code points together."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or k == len(texts) - 1:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0


class Model:
    """Learned languages, the filter table and each language's false-positive rate."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table
        bits = [(table[:, k // 63] >> np.uint64(k % 63)) & np.uint64(1) for k in range(len(languages))]
        self.false = np.array([b.mean() ** HASHES for b in bits]) if languages else np.zeros(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for _, part in _pieces([t or "" for t in texts]):
            grams, owner = ngrams(part)
            total = np.bincount(owner, minlength=len(part)).astype(float)
            masks = None
            for s in slots_of(grams):
                masks = self.table[s] if masks is None else masks & self.table[s]
            rest = np.zeros((len(self.languages), len(part)))
            for k in range(len(self.languages)):
                hit = ((masks[:, k // 63] >> np.uint64(k % 63)) & np.uint64(1)).astype(float)
                have = np.bincount(owner, weights=hit, minlength=len(part))
                rest[k] = np.maximum(0, (have - total * self.false[k]) / (1 - min(self.false[k], 0.99)))
            for i in range(len(part)):
                if not self.languages or total[i] == 0:
                    names.append("und")
                    scores.append(0.0)
                else:
                    best = int(rest[:, i].argmax())
                    names.append(self.languages[best])
                    scores.append(float(min(1.0, rest[best, i] / total[i])))
        return names, scores


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) of a table with ``lang`` and ``body``; one row per task and n-gram is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def fold(lang: str) -> None:
            grams = np.concatenate([g for g, _ in held[lang]])
            counts = np.concatenate([c for _, c in held[lang]])
            keys, at = np.unique(grams, return_inverse=True)
            held[lang] = [(keys, np.bincount(at, weights=counts).astype(np.int64))]

        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            texts = np.array(b.column(1).to_pylist(), object)
            for lang in set(langs):
                for _, part in _pieces(list(texts[langs == lang])):
                    grams, _ = ngrams(part)
                    held.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                    if len(held[lang]) > 16:
                        fold(lang)
        for lang in held:
            fold(lang)
            keys, counts = held[lang][0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"]
            )

    rows = labelled.mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on every row with a non-null label; collects SLOTS masks at most."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    )
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())  # one row per language
    counts = count_ngrams(rows)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    # FLOOR leaves 1 / FLOOR n-grams of a language at most.
    kept = rates.where(F.col("rate") >= FLOOR).withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("top"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: k for k, lang in enumerate(languages)}
        for b in batches:
            k = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            for s in slots_of(np.array(b.column(1).to_pylist(), np.int64).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(k // 63), pa.array(np.int64(1) << (k % 63))], ["slot", "word", "mask"])

    masks = kept.select("lang", "gram").mapInArrow(spread, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    table = np.zeros((SLOTS, max(1, -(-len(languages) // 63))), np.uint64)
    for r in masks.toPandas().itertuples(index=False):
        table[r.slot, r.word] = np.uint64(r.mask)
    return Model(languages, table)


def predictor(spark: SparkSession, model: Model):
    """A column function: text to struct(``lang_pred``, ``score``)."""
    shared = spark.sparkContext.broadcast((model.languages, model.table))  # fixed size

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = Model(*shared.value).predict(list(texts))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred`` and ``score`` (share of the text's n-grams the language has, 0 to 1) of every row."""
    found = docs.select(F.col(id_col), predictor(docs.sparkSession, model)(F.col(text_col)).alias("found"))
    return found.select(F.col(id_col), "found.lang_pred", "found.score")


def drop_unknown_language(docs: DataFrame, least: float = 0.25, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows whose text some learned language explains; learned from the rows' own labels.

    A row goes if its text has no letter, or if no language has ``least`` of its
    n-grams.  Where no row is labelled nothing can be judged and all rows stay.
    Columns are unchanged; nothing but the counts of learning is shuffled.
    """
    model = learn(docs, text_col, lang_col)
    if not model.languages:
        return docs
    found = fresh(docs, "language_found")
    judged = docs.withColumn(found, predictor(docs.sparkSession, model)(F.col(text_col)))
    return judged.where((F.col(found)["lang_pred"] != "und") & (F.col(found)["score"] >= least)).drop(found)
