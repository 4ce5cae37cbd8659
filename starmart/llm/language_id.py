"""Language ID: a linear-chain conditional random field that labels words.

A word's features are character n-grams of the framed word (those at its ends are
its affixes) and the word itself if the learned lexicon has it. Features and
transitions between the labels of neighbouring words are learned together. The
forward-backward algorithm gives each word's label probabilities; a text in
several languages is labelled word by word, and a document's language is the one
with the largest sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from starmart.llm import sampling
from starmart.llm.common import id_remainder, let, runs_on_executors

runs_on_executors(__name__)

SAMPLE_ROWS_PER_LABEL = 300
SAMPLE_CHARS = 4_000_000
BITS = 18
LENGTHS = (2, 3, 4)
EPOCHS = 20
MOST_IN_CHAIN = 512
WORDS_AT_ONCE = 400_000
EDGES = ".,;:!?|#$%&*()\"'"
UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Labels, feature weights (hash x label) and transition scores (from x to)."""

    labels: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray


@dataclass(frozen=True)
class Chains:
    """Words of some texts: their distinct forms and, per chain, a span of words.

    Chains are in falling order of length. ``text`` says which text a chain is of.
    """

    forms: list[str]
    form: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray


def chains(texts: list[str]) -> Chains:
    """Every line is a chain; longer lines are cut after ``MOST_IN_CHAIN`` words."""
    tokens: list[str] = []
    length, text = [], []
    for i, content in enumerate(texts):
        for line in content.split("\n"):
            found = line.split()
            tokens += found
            for at in range(0, len(found), MOST_IN_CHAIN):
                length.append(min(MOST_IN_CHAIN, len(found) - at))
                text.append(i)
    form, forms = pd.factorize(np.array(tokens, dtype=object))
    lengths = np.array(length, np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = np.cumsum(lengths) - lengths
    return Chains(list(forms), form, starts[order], lengths[order], np.array(text, np.int64)[order])


def form_features(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes, index of the word they belong to); none if it has no letter."""
    cleaned = [form.lower().strip(EDGES) for form in forms]
    cleaned = [f"^{w}$" if any(map(str.isalpha, w)) else "" for w in cleaned]
    sizes = np.array([len(w) for w in cleaned], np.int64)
    codes = np.frombuffer("".join(cleaned).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(forms)), sizes)
    hashed, of = [], []
    sums, power = codes, 1
    for n in range(2, max(LENGTHS) + 1):
        if len(codes) < n:
            break
        power = power * 0x100000001B3 % (1 << 64)
        sums = sums[:-1] + codes[n - 1 :] * np.uint64(power)
        if n in LENGTHS:
            inside = owner[: len(sums)] == owner[n - 1 :]
            hashed.append(_slot(sums[inside], n))
            of.append(owner[: len(sums)][inside])
    some = np.flatnonzero(sizes)
    if len(some):
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        powers = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, np.uint64))
        starts = (np.cumsum(sizes) - sizes)[some]
        hashed.append(_slot(np.add.reduceat(codes * powers[place], starts), 99))
        of.append(some)
    if not hashed:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashed), np.concatenate(of)


def _slot(sums: np.ndarray, kind: int) -> np.ndarray:
    mixed = (sums ^ (sums >> np.uint64(31))) * _STEP + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _STEP
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def forward_backward(
    found: Chains, emission: np.ndarray, transitions: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities of each word, expected transitions).

    All chains advance together; those that have ended are the last ones.
    """
    n, k = len(found.form), emission.shape[1]
    e = np.exp(emission - emission.max(axis=1, keepdims=True))[found.form]
    step = np.exp(transitions)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    longest = int(found.length[0]) if len(found.length) else 0
    active = np.searchsorted(-found.length, -np.arange(longest), side="left")
    for t in range(longest):
        at = found.start[: active[t]] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ step) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros((k, k))
    for t in range(longest - 1, -1, -1):
        at = found.start[: active[t]] + t
        b = np.full((len(at), k), 1.0 / k)
        going = active[t + 1] if t + 1 < longest else 0
        if going:
            onward = e[at[:going] + 1] * beta[at[:going] + 1]
            b[:going] = onward @ step.T
            b[:going] /= b[:going].sum(axis=1, keepdims=True)
            total = ((alpha[at[:going]] @ step) * onward).sum(axis=1, keepdims=True)
            expected += step * (alpha[at[:going]].T @ (onward / total))
        beta[at] = b
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True), expected


def _emission(forms: int, hashed: np.ndarray, of: np.ndarray, weights: np.ndarray) -> np.ndarray:
    columns = [np.bincount(of, weights[hashed, j], forms) for j in range(weights.shape[1])]
    return np.column_stack(columns)


def fit_rows(texts: list[str], langs: list[str], epochs: int = EPOCHS) -> Model:
    """Maximum likelihood of the labels, each word of a text bearing the text's language."""
    labels = tuple(sorted(set(langs)))
    k = len(labels)
    weights, transitions = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k))
    found = chains(texts)
    if k < 2 or not len(found.form):
        return Model(labels, weights, transitions)
    truth_of_text = np.array([labels.index(lang) for lang in langs])
    truth_of_chain = truth_of_text[found.text]
    truth = np.empty(len(found.form), np.int64)
    for start, length, label in zip(found.start, found.length, truth_of_chain, strict=True):
        truth[start : start + length] = label
    hashed, of = form_features(found.forms)
    wanted = np.zeros((len(found.forms), k))
    np.add.at(wanted, (found.form, truth), 1)
    seen = np.bincount(truth_of_chain, found.length - 1, k)
    used = np.unique(hashed)
    column = np.searchsorted(used, hashed)
    small = np.zeros((len(used), k))
    n = len(found.form)
    sq, sq_t = np.full(small.shape, 1e-8), np.full(transitions.shape, 1e-8)
    for _ in range(epochs):
        emission = _emission(len(found.forms), column, of, small)
        gamma, expected = forward_backward(found, emission, transitions)
        have = np.column_stack([np.bincount(found.form, gamma[:, j], len(wanted)) for j in range(k)])
        error = (wanted - have)[of] / n
        up = np.column_stack([np.bincount(column, error[:, j], len(used)) for j in range(k)])
        up -= 1e-7 * small
        up_t = (np.diag(seen) - expected) / n - 1e-3 * transitions
        sq, sq_t = sq + up**2, sq_t + up_t**2
        small += 0.5 * up / np.sqrt(sq)
        transitions += 0.5 * up_t / np.sqrt(sq_t)
    weights[used] = small
    return Model(labels, weights, transitions)


def label_words(texts: list[str], model: Model) -> tuple[Chains, np.ndarray]:
    """The words of some texts and each one's label probabilities."""
    found = chains(texts)
    hashed, of = form_features(found.forms)
    emission = _emission(len(found.forms), hashed, of, model.weights)
    return found, forward_backward(found, emission, model.transitions)[0]


def language_of(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, its mean probability over the words) of each text."""
    k = len(model.labels)
    sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts))
    found, gamma = label_words(texts, model)
    if len(found.form):
        order = np.argsort(found.start)
        of = np.repeat(found.text[order], found.length[order])
        for j in range(k):
            sums[:, j] = np.bincount(of, gamma[:, j], len(texts))
        counts = np.bincount(of, minlength=len(texts)).astype(float)
    best = sums.argmax(axis=1)
    return best, sums[np.arange(len(texts)), best] / np.maximum(counts, 1)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS_PER_LABEL) -> Model:
    """The model of a bounded sample: at most ``rows`` documents of each language.

    Each language has its own share of the characters, so all of them are learned.
    Rows whose crc32 of the id modulo 3 is 1 are held out and never learned from.
    The languages of a corpus are taken to be few.
    """
    eligible = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).where(
        (id_remainder(F.col("doc_id"), 3) != 1) & F.col("text").rlike(r"\p{L}")
    )
    ids = eligible.select("doc_id", F.col("lang").alias("label"))
    # About four times the rows that are wanted of a label reach its window; the counts,
    # one row for each language, come to the rows, so that no language moves whole.
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = ids.groupBy("label").count()
    ids = ids.join(F.broadcast(counts), "label").where(share * F.col("count") <= 4 * rows)
    of_label = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    top = ids.withColumn("place", F.row_number().over(of_label)).where(F.col("place") <= rows)
    top = top.groupBy("doc_id").agg(F.min("label").alias("label"))
    found = sampling.bounded(docs, top, chars=SAMPLE_CHARS, per_label=True)
    collected = found.orderBy("doc_id").toPandas()
    return fit_rows(collected["text"].tolist(), collected["label"].tolist())


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``WORDS_AT_ONCE`` words (blanks are counted)."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) // 6 + 1
        if size >= WORDS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def predict(text: Column, model: Model) -> Column:
    """Struct of lang_pred and score; ``und`` and 0 if text is null or has no letter."""

    @pandas_udf("best int, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [language_of(group, model) for group in _groups(batch.fillna("").tolist())]
            best = [np.concatenate(column) for column in zip(*parts, strict=True)] if parts else [[], []]
            yield pd.DataFrame({"best": best[0], "score": best[1]})

    if not model.labels:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    known = text.isNotNull() & text.rlike(r"\p{L}")
    names = F.array(*map(F.lit, model.labels))
    found = F.when(known, predicted(text))
    return let(
        found,
        lambda x: F.struct(
            F.coalesce(F.get(names, x["best"]), F.lit(UNKNOWN)).alias("lang_pred"),
            F.coalesce(x["score"], F.lit(0.0)).alias("score"),
        ),
    )


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    A text that is null or has no letter is ``und`` with a score of 0; so is
    every text if no document has a language. With one language only, that one
    is predicted. Repeated rows get a row each. Other columns are not read.
    """
    model = fit(docs)
    predicted = docs.select("doc_id", predict(F.col("text"), model).alias("p"))
    return predicted.select(
        "doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "p.lang_pred", "p.score"
    )
