"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters and marks becomes one blank (the last word has one too), and the bigrams and
trigrams of what is left are hashed into a fixed number of buckets.  Training counts buckets per language in the tasks and adds the counts up by
slices; the model is a matrix of log-probabilities, as large as languages times buckets, and goes to the tasks as a
broadcast.  A text's score is the sparse product of its n-gram counts with that matrix, computed piece by piece and
language by language: beside the model, a task holds about half a megabyte of text (one text at least) and some 40 bytes for each
of its characters, however many languages there are.

``train`` takes at most about ``per_language`` texts of each language (a share of them chosen by a hash of the id);
that bound is a parameter.  Scoring covers every row and the whole text.

Edge cases: a null text, or one without letters (Unicode category L), is ``und`` with score 0; so is everything if nothing
was learned, as from an empty table.  An empty table to predict gives an empty one.  Rows without language teach nothing.  Languages that score the same resolve to the alphabetically first.  A null id
stays null and repeated rows give equal rows; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common

BUCKETS = 1 << 16
SLICE = 1 << 12
SMOOTHING = 0.5
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # (languages, BUCKETS + 1); the last column is zero and stands for "no n-gram"


@lru_cache(maxsize=2)
def _letters(categories: str = "LM") -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in categories for c in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of all texts in lower case, each with a blank and a zero after it."""
    codes = np.frombuffer((" \0".join(texts).lower() + " \0").encode("utf-32-le", "surrogatepass"), np.uint32)
    if np.count_nonzero(codes == 0) != len(texts):  # texts with zero characters of their own
        return _codes([t.replace("\0", " ") for t in texts])
    return codes


def has_letter(codes: np.ndarray) -> np.ndarray:
    """Which texts hold a letter; marks alone are none."""
    starts = np.flatnonzero(np.r_[0, codes[:-1]] == 0)
    return np.logical_or.reduceat(_letters("L")[codes], starts)


def ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of bigrams and of trigrams at every kept place (BUCKETS: none), and where each text begins and ends."""
    ends = np.flatnonzero(codes == 0)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    keep[ends] = True
    text = np.where(letter, codes, 32).astype(np.uint64)
    text[ends] = 0
    text = text[keep]
    stops = np.flatnonzero(text == 0)
    a, b = text[:-1], text[1:]
    pair = np.full(len(text), BUCKETS, np.int32)
    pair[:-1] = np.where((a != 0) & (b != 0), _bucket(a * np.uint64(0x10001) + b), BUCKETS)
    a, b, c = text[:-2], text[1:-1], text[2:]
    triple = np.full(len(text), BUCKETS, np.int32)
    triple[:-2] = np.where((a != 0) & (b != 0) & (c != 0), _bucket((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c),
                           BUCKETS)
    return pair, triple, np.r_[0, stops + 1]


def _bucket(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(48)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket counts of all rows of a task, by language, in slices."""
    totals: dict[str, np.ndarray] = {}
    for piece in common.pieces(batches, 1):
        languages = piece.column(0).to_pylist()
        pair, triple, at = ngrams(_codes([t or "" for t in piece.column(1).to_pylist()]))
        for i, language in enumerate(languages):
            own = totals.setdefault(language, np.zeros(BUCKETS + 1, np.int64))
            own += np.bincount(pair[at[i]:at[i + 1]], minlength=BUCKETS + 1) if at[i + 1] - at[i] > SLICE else 0
            if at[i + 1] - at[i] <= SLICE:
                np.add.at(own, pair[at[i]:at[i + 1]], 1)
            np.add.at(own, triple[at[i]:at[i + 1]], 1)
    rows = [(language, k // SLICE, counts[k:k + SLICE].tobytes())
            for language, counts in totals.items() for k in range(0, BUCKETS, SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                      pa.array([r[1] for r in rows], pa.int32()),
                                      pa.array([r[2] for r in rows], pa.binary())], ["lang", "slice", "counts"])


def _add(part: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in part["counts"])
    return pd.DataFrame({"lang": part["lang"].iloc[:1], "slice": part["slice"].iloc[:1], "counts": [total.tobytes()]})


def train(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
          per_language: int = 4_000, most_languages: int = 1_000) -> Model:
    """Learn from the rows with a language.  ``per_language`` bounds the texts that each language gives (about), and
    ``most_languages`` the size of the model; more languages are an error."""
    labelled = df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"),
                         df[lang_column].cast("string").alias("lang")).where("lang is not null and text is not null")
    rows = labelled.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not rows:
        return Model((), np.zeros((0, BUCKETS + 1)))
    share = F.lit(0.0)
    for row in rows:
        share = F.when(F.col("lang") == row["lang"], min(1.0, per_language / row["count"])).otherwise(share)
    place = (F.xxhash64(F.lit("sample"), "id") / F.lit(2.0 ** 64) + 0.5)
    counts = (labelled.where(place < share).select("lang", "text")
              .mapInArrow(_count, "lang string, slice int, counts binary")
              .groupBy("lang", "slice").applyInPandas(_add, "lang string, slice int, counts binary").collect())
    languages = tuple(sorted({row["lang"] for row in counts}))
    table = np.zeros((len(languages), BUCKETS))
    for row in counts:
        table[languages.index(row["lang"]), row["slice"] * SLICE:(row["slice"] + 1) * SLICE] = \
            np.frombuffer(row["counts"], np.int64)
    table = np.log(table + SMOOTHING) - np.log(table.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    return Model(languages, np.hstack([table, np.zeros((len(languages), 1))]))


def _likely(buckets: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """The sum of log-probabilities by text and language.  A language at a time, so that what is gathered does not grow with
    the number of languages."""
    return np.stack([np.add.reduceat(row.take(buckets), starts) for row in model.log_prob], 1)


def score_texts(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior probability, and how much likelier an n-gram is on average than by chance (in nats)."""
    codes = _codes(texts)
    pair, triple, at = ngrams(codes)
    n = np.add.reduceat((pair < BUCKETS).astype(np.int64) + (triple < BUCKETS), at[:-1])
    k = len(model.languages)
    if not k:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    likely = _likely(pair, at[:-1], model) + _likely(triple, at[:-1], model)
    best = likely.argmax(1)
    top = likely.max(1)
    score = 1 / np.exp(likely - top[:, None]).sum(1)
    none = ~has_letter(codes)
    score[none] = 0
    fit = np.where(none, 0, top / np.maximum(n, 1) + np.log(BUCKETS))
    return [UNDETERMINED if none[i] else model.languages[b] for i, b in enumerate(best)], score, fit


def predict(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``lang_pred``, ``score`` (0 to 1) and ``fit`` for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, 1, 1 << 19):
            lang, score, fit = score_texts([t or "" for t in piece.column(1).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang, pa.string()), pa.array(score),
                                              pa.array(fit)], ["id", "lang_pred", "score", "fit"])

    kind = df.schema[id_column].dataType.simpleString()
    return (df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
            .mapInArrow(each, f"id {kind}, lang_pred string, score double, fit double")
            .withColumnRenamed("id", id_column))


def keep_identified(df: DataFrame, model: Model, min_score: float = 0.5, min_fit: float = 0.0,
                    text_column: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is determined, with at least ``min_score`` and ``min_fit``.  A fit below 0 means
    that the text is less like any learned language than chance."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, at, 1 << 19):
            lang, score, fit = score_texts([t or "" for t in piece.column(at).to_pylist()], shared.value)
            keep = (np.array(lang) != UNDETERMINED) & (score >= min_score) & (fit >= min_fit)
            yield piece.filter(pa.array(keep))

    return df.mapInArrow(each, df.schema)
