"""Toxicity: a linear classifier over character n-grams scaled by log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters, hashed
into a fixed table. Each feature present has the value r, the naive Bayes
log-count ratio of the two classes; a logistic model is fitted on these. What is
left for scoring is one weight per hashed n-gram (r times its coefficient): a
table of fixed size, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from starmart.llm import sampling
from starmart.llm.common import fresh, id_remainder, runs_on_executors

runs_on_executors(__name__)

LENGTHS = (5, 7)
BITS = 20
SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 20_000_000
LEAST_ERRORS = 3.0
LEAST_WEIGHT = 0.05
STEPS = 80
CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Weight of each hashed n-gram and the bias."""

    weights: np.ndarray
    bias: float


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(characters, index of their text), at most about ``CHUNK`` at a time.

    Texts are framed by blanks. A long one is cut into pieces that overlap by one
    n-gram less a character, so every n-gram of it is in exactly one piece or,
    with the same hash, in two.
    """
    overlap = max(LENGTHS) - 1
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
        for start in range(0, max(1, len(codes) - overlap), CHUNK):
            piece = codes[start : start + CHUNK + overlap]
            held.append(piece)
            owners.append(np.full(len(piece), i, np.int32))
            size += len(piece)
            if size >= CHUNK:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owners)


def _hashed(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, whether it lies in one text) at every character, one length at a time."""
    sums = codes.astype(np.uint64)
    wide, power = sums, 1
    for n in range(2, max(LENGTHS) + 1):
        if len(codes) < n:
            return
        power = power * 0x100000001B3 % (1 << 64)
        sums = sums[:-1] + wide[n - 1 :] * np.uint64(power)
        if n in LENGTHS:
            mixed = (sums ^ (sums >> np.uint64(29))) * _MIX + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int32), owner[: len(sums)] == owner[n - 1 :]


def features(text: str) -> np.ndarray:
    """The distinct hashed n-grams of a text, in order."""
    found = [h for codes, owner in _pieces([text]) for h, _ in _hashed(codes, owner)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


def margins(texts: list[str], model: Model) -> np.ndarray:
    """The linear score of each text; every distinct n-gram counts once."""
    keys = [np.empty(0, np.int64)]
    useful = model.weights != 0
    for codes, owner in _pieces(texts):
        for hashed, inside in _hashed(codes, owner):
            at = np.flatnonzero(useful[hashed] & inside)
            keys.append((owner[at].astype(np.int64) << BITS) | hashed[at])
    distinct = np.unique(np.concatenate(keys))
    gained = model.weights[distinct & ((1 << BITS) - 1)]
    return model.bias + np.bincount(distinct >> BITS, gained, len(texts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_rows(rows: list[np.ndarray], label: np.ndarray, ridge: float = 1e-3) -> Model:
    """The model of these feature lists and labels; constant if a class is missing."""
    weights = np.zeros(1 << BITS, np.float32)
    positive = label == 1
    if not positive.any() or positive.all():
        share = (positive.sum() + 0.5) / (len(label) + 1)
        return Model(weights, float(np.log(share / (1 - share))))
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for found, is_positive in zip(rows, positive, strict=True):
        (p if is_positive else q)[found] += 1
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    used = np.abs(ratio) >= LEAST_ERRORS * np.sqrt(1 / (p + 1) + 1 / (q + 1))
    kept = [found[used[found]] for found in rows]
    row = np.repeat(np.arange(len(rows)), [len(k) for k in kept])
    place = np.cumsum(used) - 1
    column = place[np.concatenate(kept)]
    r = ratio[used]
    values = r[column]

    each = np.where(positive, np.sqrt((~positive).sum() / positive.sum()), 1.0)
    each /= each.sum()
    coefficients, bias = np.zeros(len(r)), 0.0
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for step in range(1, STEPS + 1):
        margin = np.bincount(row, values * coefficients[column], len(rows)) + bias
        error = (_sigmoid(margin) - positive) * each
        slope = np.bincount(column, values * error[row], len(r)) + ridge * coefficients
        gradient = np.append(slope, error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        coefficients, bias = coefficients - move[:-1], bias - move[-1]
    gained = coefficients * r
    weights[used] = np.where(np.abs(gained) < LEAST_WEIGHT, 0, gained)
    return Model(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample: at most ``rows`` labelled rows.

    One task learns from the sample and returns the table of weights. Rows whose crc32 of the id modulo 5 is 0 are held out and never learned from.
    """
    eligible = sampling.labelled(labels, label).where(id_remainder(F.col("doc_id"), 5) != 0)
    sample = sampling.bounded(docs, eligible, rows, SAMPLE_CHARS)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [
            (doc_id, label, features(text))
            for frame in frames
            for doc_id, label, text in frame.itertuples(index=False)
        ]
        found.sort(key=lambda row: row[0])
        model = fit_rows([f for _, _, f in found], np.array([y for _, y, _ in found], int))
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    learned = sample.select("doc_id", "label", "text").repartition(1).mapInPandas(
        learn, "weights binary, bias double"
    )
    row = learned.first()
    if row is None:  # nothing to learn from
        return fit_rows([], np.empty(0, int))
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"])


def score(text: Column, model: Model) -> Column:
    """0 to 1, higher: label 1 likelier; a text of null counts as empty."""

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_sigmoid(margins(texts.fillna("").tolist(), model)))

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts get the score of an empty text. Repeated rows get a row
    each, equal texts equal scores. Ids of null count as empty text when rows are
    held out. Other columns are not read. Without labelled rows the score is 0.5.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with the same columns."""
    name = fresh(docs, "toxicity")
    scored = docs.withColumn(name, score(F.col("text"), fit(docs, labels)))
    return scored.where(F.col(name) < 0.5).drop(name)
