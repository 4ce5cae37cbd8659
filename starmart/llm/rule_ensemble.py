"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on the statistics of a bounded labelled sample.
Every path from a root is a conjunctive rule; a lasso logistic regression gives
each rule a weight and most of them none. The rest become one Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.llm import sampling
from starmart.llm.common import BLANKS, id_remainder, let, whole, words

SAMPLE_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 32
LASSO = 0.001

STATISTICS = (
    "log_words",
    "chars_per_word",
    "symbols_per_word",
    "bars_per_word",
    "marks_per_word",
    "upper_share",
    "digit_share",
    "same_as_previous",
    "distinct_words",
    "dup_lines",
    "words_per_line",
    "plain_share",
)

Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class Rule:
    """All conditions must hold: (statistic, at most?, bound)."""

    conditions: tuple[Condition, ...]
    weight: float


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    bias: float


def statistics(text: Column) -> Column:
    """Struct of a text's statistics; those of an empty or null text are all 0."""
    content = whole(text)

    def size_of(pattern: str) -> Column:
        return F.length(F.regexp_replace(content, pattern, "")).cast("double")

    lines = F.filter(F.split(content, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")

    def line_part(lines_: Column) -> Column:
        n = F.size(lines_)
        return F.struct(
            n.alias("n"),
            ((n - F.size(F.array_distinct(lines_))) / F.greatest(n, F.lit(1))).alias("dup"),
        )

    def of(words_: Column) -> Column:
        n = F.size(words_).cast("double")
        base = F.greatest(n, F.lit(1.0))
        same = F.size(
            F.filter(words_, lambda w, i: F.coalesce(F.get(words_, i - 1) == w, F.lit(False)))
        )
        line = let(lines, line_part)
        chars = F.greatest(F.length(content).cast("double"), F.lit(1.0))
        values = (
            F.log1p(n),
            F.length(F.array_join(words_, "")) / base,
            size_of(r"[^#*$%&<>]+") / base,
            size_of(r"[^|]+") / base,
            size_of(r"[^!?]+") / base,
            size_of(r"[^A-Z]+") / chars,
            size_of(r"[^0-9]+") / chars,
            same / base,
            F.size(F.array_distinct(words_)) / base,
            line["dup"],
            n / F.greatest(line["n"], F.lit(1)),
            size_of(r"[^a-z ]+") / chars,
        )
        return F.struct(*[v.cast("double").alias(s) for v, s in zip(values, STATISTICS, strict=True)])

    return let(words(text), of)


def _splits(x: np.ndarray) -> list[np.ndarray]:
    """Candidate bounds of each statistic, halfway between neighbouring quantiles."""
    found = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)))
        found.append((q[:-1] + q[1:]) / 2)
    return found


def _grow(
    x: np.ndarray,
    residual: np.ndarray,
    bounds: list[np.ndarray],
    rows: np.ndarray,
    every: np.ndarray,
    path: tuple,
    out: list,
) -> np.ndarray:
    """Adds the paths of a regression tree over ``rows`` to ``out``; its value for ``every`` row."""
    mean = residual[rows].mean()
    values = np.full(len(every), mean)
    if len(path) == DEPTH or len(rows) < 20:
        return values
    best = (1e-9, -1, 0.0)
    for s, cuts in enumerate(bounds):
        if not len(cuts):
            continue
        bins = np.searchsorted(cuts, x[rows, s], side="left")
        n = np.cumsum(np.bincount(bins, minlength=len(cuts) + 1))[:-1]
        total = np.cumsum(np.bincount(bins, residual[rows], len(cuts) + 1))[:-1]
        m = len(rows) - n
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (total / n - (residual[rows].sum() - total) / m) ** 2 * n * m / len(rows)
        gain[(n < 10) | (m < 10)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), s, float(cuts[k]))
    if best[1] < 0:
        return values
    low = x[rows, best[1]] <= best[2]
    for side in (True, False):
        branch = (*path, (best[1], side, best[2]))
        out.append(branch)
        here = (x[every, best[1]] <= best[2]) == side
        values[here] = _grow(x, residual, bounds, rows[low == side], every[here], branch, out)
    return values


def holds(conditions: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    parts = [(x[:, s] <= b) if low else (x[:, s] > b) for s, low, b in conditions]
    return np.logical_and.reduce(parts)


def fit_rows(x: np.ndarray, label: np.ndarray, seed: int = 0) -> Ensemble:
    """The ensemble of these statistics and labels; constant if a class is missing."""
    share = (label.sum() + 0.5) / (len(label) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(label) == 0 or label.min() == label.max():
        return Ensemble((), bias)
    random, bounds = np.random.default_rng(seed), _splits(x)
    paths: list[tuple[Condition, ...]] = []
    margin = np.full(len(label), bias)
    for _ in range(TREES):
        residual = label - 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(random.random(len(label)) < 0.5)
        if len(rows):
            margin += 2.0 * _grow(x, residual, bounds, rows, np.arange(len(label)), (), paths)
    rules = sorted({tuple(sorted(p)) for p in paths})
    if not rules:
        return Ensemble((), bias)
    f = np.column_stack([holds(rule, x) for rule in rules]).astype(float)
    weights = np.zeros(len(rules))
    step = 4 * len(label) / (np.linalg.norm(f, 2) ** 2 + len(label))
    ahead, momentum = weights.copy(), 1.0
    for _ in range(300):
        error = 1 / (1 + np.exp(-(f @ ahead + bias))) - label
        moved = ahead - step * (f.T @ error) / len(label)
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
        bias -= step * error.mean()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = shrunk + (momentum - 1) / following * (shrunk - weights)
        weights, momentum = shrunk, following
    kept = [Rule(rule, float(w)) for rule, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]
    return Ensemble(tuple(kept), float(bias))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Ensemble:
    """The ensemble of a bounded sample: at most ``rows`` labelled rows.

    Rows whose crc32 of the id modulo 5 is 0 are held out and never learned from.
    Statistics are computed by Spark; twelve numbers per sampled row are collected.
    """
    eligible = sampling.labelled(labels, label).where(id_remainder(F.col("doc_id"), 5) != 0)
    sample = sampling.bounded(docs, eligible, rows)
    found = sample.select("doc_id", "label", statistics(F.col("text")).alias("s"))
    collected = sorted(found.select("doc_id", "label", "s.*").collect(), key=lambda r: r["doc_id"])
    x = np.array([[row[s] for s in STATISTICS] for row in collected]).reshape(-1, len(STATISTICS))
    return fit_rows(x, np.array([row["label"] for row in collected], float))


def compiled(ensemble: Ensemble, of: Column) -> Column:
    """The score as one expression over the struct of statistics."""

    def met(rule: Rule) -> Column:
        tests = [
            (of[STATISTICS[s]] <= F.lit(b)) if low else (of[STATISTICS[s]] > F.lit(b))
            for s, low, b in rule.conditions
        ]
        return F.when(reduce(lambda a, b: a & b, tests), rule.weight).otherwise(0.0)

    margin = reduce(lambda a, b: a + b, map(met, ensemble.rules), F.lit(ensemble.bias))
    return 1 / (1 + F.exp(-margin))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts get the score of an empty text. Repeated rows get a row
    each, equal texts equal scores. Other columns of ``docs`` are not read.
    Without labelled rows the score is 0.5.
    """
    ensemble = fit(docs, labels)
    measured = docs.select("doc_id", statistics(F.col("text")).alias("s"))
    scored = measured.withColumn("score", compiled(ensemble, F.col("s")))
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
