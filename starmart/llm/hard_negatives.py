"""Hard-negative mining with exact scores from a residue number system.

Vectors become integers, and a score is an integer inner product. It is computed
modulo several small primes: residues are small enough for a float32 product of
matrices to be exact, and Chinese remaindering puts the signed score together
again. Selection then works on exact numbers: an anchor's best rows of its own label
are its positives, and a window below each positive's score holds its negatives.

The anchors (the stated query set) come in waves of a bounded number of bytes. Every
task holds one wave and passes its share of all rows by it, block by block, keeping
only the best rows so far for each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm.common import runs_on_executors, stored

runs_on_executors(__name__)

SCALE = 256
ANCHOR_STEP = 50
POSITIVES = 5
NEGATIVES = 3
#: Negatives score between these percentages of their positive.
LEAST_PERCENT, MOST_PERCENT = 50, 95
WAVE_BYTES = 8_000_000
TILE, BLOCK = 256, 4096
#: A product of two residues is at most 125 * 125; sums of so many stay exact in float32.
INNER = 1024
#: The largest primes below 256.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199, 197)
MOST_SCORE = 1 << 62

Residues = list[np.ndarray]


def enough_primes(bound: int) -> tuple[int, ...]:
    """The first primes whose product tells apart all scores from -bound to bound."""
    for k in range(2, len(PRIMES) + 1):
        if bound < MOST_SCORE and math.prod(PRIMES[:k]) > 2 * bound + 1:
            return PRIMES[:k]
    raise ValueError(f"scores up to {bound} do not fit in 62 bits")


def _balanced(x: np.ndarray, p: int, wide: bool = False) -> np.ndarray:
    """``x`` modulo ``p`` between -p/2 and p/2, in place; ``wide`` for large ``x``."""
    for _ in range(1 + wide):
        x -= np.float32(p) * np.rint(x * np.float32(1 / p))
    return x


def residues(q: np.ndarray, primes: tuple[int, ...]) -> Residues:
    """The component matrix of integers modulo each prime, as float32."""
    return [((q + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def product(a: Residues, b: Residues, primes: tuple[int, ...]) -> list[np.ndarray]:
    """``a`` times the transpose of ``b`` modulo each prime."""
    done = []
    for x, y, p in zip(a, b, primes, strict=True):
        total = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, x.shape[1], INNER):
            part = x[:, at : at + INNER] @ y[:, at : at + INNER].T
            wide = min(INNER, x.shape[1] - at) * (p // 2) ** 2 >= 1 << 21
            total = _balanced(total + _balanced(part, p, wide) if at else part, p, wide)
        done.append(total)
    return done


def signed(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The numbers behind their residues: balanced digits of a mixed radix.

    Digits are found one prime after the other and add up to the signed number. The
    result has the smallest type that holds it: float32, float64 or int64.
    """
    size = math.prod(primes)
    kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64
    digits: list[np.ndarray] = []
    weights = [math.prod(primes[:i]) for i in range(len(primes))]
    for i, p in enumerate(primes):
        digit = parts[i]
        if i:
            digit = digit.copy()
            for weight, lower in zip(weights, digits, strict=False):
                digit -= np.float32((weight + p // 2) % p - p // 2) * lower
            inverse = pow(weights[i], -1, p)
            digit = _balanced(digit, p) * np.float32((inverse + p // 2) % p - p // 2)
            digit = _balanced(digit, p)
        digits.append(digit)
    total = digits[0].astype(kind)
    for weight, digit in zip(weights[1:], digits[1:], strict=True):
        total += kind(weight) * digit.astype(kind, copy=False)
    return total


class Best:
    """The ``k`` best rows (score, then smaller id) so far, for each anchor and slot."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.scores = np.full((slots, anchors, k), -MOST_SCORE, np.int64)
        self.ids = np.zeros((slots, anchors, k), np.int64)

    def take(self, slot: int, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (anchors by rows, less than any score where a row does not count).

        ``ids`` rise, so of equal scores the first has the smallest id.
        """
        k = self.scores.shape[2]
        least = self.scores[slot, at, -1]
        top = scores.max(axis=1)
        rows = np.flatnonzero((top.astype(np.int64) >= least) & (top > -MOST_SCORE))
        if not len(rows):
            return
        some = scores[rows]
        line = np.arange(len(rows))
        found, of = [], []
        for _ in range(min(k, some.shape[1])):
            best = some.argmax(axis=1)
            found.append(some[line, best].astype(np.int64))
            of.append(ids[best])
            some[line, best] = -MOST_SCORE
        where = rows + at.start
        both = np.concatenate([self.scores[slot, where], np.stack(found, 1)], axis=1)
        both_ids = np.concatenate([self.ids[slot, where], np.stack(of, 1)], axis=1)
        order = np.lexsort((both_ids, -both), axis=1)[:, :k]
        self.scores[slot, where] = np.take_along_axis(both, order, axis=1)
        self.ids[slot, where] = np.take_along_axis(both_ids, order, axis=1)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of components; what is missing at the end of a shorter vector is 0."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


Wave = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]

_FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"


def _scan(wave, width: int, primes: tuple[int, ...], k: int, same_label: bool):
    """All rows of a partition by the anchors of a wave.

    An anchor has one or more windows of scores (slots); each keeps its ``k`` best rows
    of the anchor's own label, or of other labels.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q, low, high = wave.value
        best = Best(len(ids), low.shape[1], k)
        for batch in batches:
            row_ids = batch.column("vec_id").to_numpy()
            row_labels = batch.column("label").to_numpy()
            rows = _matrix(batch.column("q"), width)
            for start in range(0, len(rows), BLOCK):
                order = start + np.argsort(row_ids[start : start + BLOCK], kind="stable")
                block = residues(rows[order], primes)
                for at in range(0, len(ids), TILE):
                    tile = slice(at, min(at + TILE, len(ids)))
                    scores = signed(product(residues(q[tile], primes), block, primes), primes)
                    counts = labels[tile, None] == row_labels[None, order]
                    if same_label:
                        counts &= ids[tile, None] != row_ids[None, order]
                    else:
                        np.logical_not(counts, out=counts)
                    none = scores.dtype.type(-MOST_SCORE)
                    scores[~counts] = none
                    for slot in range(low.shape[1]):
                        floor = np.maximum(low[tile, slot], best.scores[slot, tile, -1])
                        inside = scores >= floor.astype(scores.dtype)[:, None]
                        inside &= scores <= high[tile, slot].astype(scores.dtype)[:, None]
                        inside &= counts
                        hit = np.flatnonzero(inside.any(axis=1))
                        if len(hit) == 0:
                            continue
                        kept = np.full(scores.shape, none)
                        np.copyto(kept, scores, where=inside)
                        best.take(slot, tile, kept, row_ids[order])
        slot, anchor, place = np.nonzero(best.scores > -MOST_SCORE)
        columns = [ids[anchor], slot.astype(np.int32), best.ids[slot, anchor, place], best.scores[slot, anchor, place]]
        names = [c.split()[0] for c in _FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return scan


def vectors(
    embeddings: DataFrame,
    vector: str = "embedding",
    relabel: Callable | None = None,
    scale: int = SCALE,
) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; ``q`` are the integer components.

    Rows without an id, a label or a vector, and those with a null or non-finite
    component, take no part. Of several rows with one id the smallest by (label, q)
    counts. ``relabel`` maps the columns of id and label to another label.
    """
    vec_id, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    values = F.col(vector).cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    used = embeddings.where(vec_id.isNotNull() & label.isNotNull() & values.isNotNull() & ~bad)
    made = used.select(
        vec_id.alias("vec_id"),
        (relabel(vec_id, label) if relabel else label).alias("label"),
        F.transform(values, lambda x: F.floor(F.lit(float(scale)) * x)).alias("q"),
    )
    one = made.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row"))
    return one.select("vec_id", "row.label", "row.q")


def _waves(anchors: DataFrame, count: int, width: int) -> Iterator[Wave]:
    """The anchors in parts of about ``WAVE_BYTES`` of components each."""
    parts = max(1, math.ceil(count * max(width, 1) * 8 / WAVE_BYTES))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    for i in range(parts):
        table = anchors.where(part == i).orderBy("vec_id").toArrow()
        if not table.num_rows:
            continue
        slots = len(table.column("low")[0])
        flat = lambda name: _matrix(_one_array(table.column(name)), slots)  # noqa: B023, E731
        yield (
            table.column("vec_id").to_numpy(),
            table.column("label").to_numpy(),
            _matrix(_one_array(table.column("q")), width),
            flat("low"),
            flat("high"),
        )


def _search(
    rows: DataFrame, anchors: DataFrame, count: int, width: int, primes: tuple[int, ...], k: int, same_label: bool
) -> DataFrame:
    """(anchor_id, slot, place, vec_id, score): the ``k`` best rows of each anchor and slot.

    Each wave is one pass over all rows; what its tasks keep is written and merged.
    """
    context = rows.sparkSession.sparkContext
    found = []
    for wave in _waves(anchors, count, width):
        shared = context.broadcast(wave)
        scanned = rows.mapInArrow(_scan(shared, width, primes, k, same_label), _FOUND)
        found.append(stored(scanned, "scored"))
        shared.unpersist()
    if not found:
        empty = rows.sparkSession.createDataFrame([], _FOUND)
        return empty.withColumn("place", F.lit(1))
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    merged = reduce(DataFrame.unionAll, found).withColumn("place", F.row_number().over(order))
    return merged.where(F.col("place") <= k)


def mine(
    rows: DataFrame,
    step: int = ANCHOR_STEP,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST_PERCENT,
    most: int = MOST_PERCENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are those of ``vectors``. Anchors are rows whose id is divisible by
    ``step``. An anchor's positives are the ``positives`` best other rows of its label,
    and each positive gets the ``negatives`` best rows of other labels that score at
    least ``least`` and at most ``most`` per cent of it; a positive below 0 has none.
    Higher scores come first, of equal ones the smaller id. Shorter vectors count as
    filled up with zeros. Without rows or anchors nothing is returned. Scores of more
    than 62 bits are refused with an error.
    """
    rows = stored(rows, "vectors")
    largest = F.array_max(F.transform("q", lambda x: F.abs(x)))
    is_anchor = F.col("vec_id") % step == 0
    size = rows.agg(
        F.max(F.size("q")).alias("width"),
        F.max(largest).alias("largest"),
        F.max(F.when(is_anchor, largest)).alias("anchor"),
        F.count(F.when(is_anchor, 1)).alias("anchors"),
    ).first()
    width = size["width"] or 0
    bound = width * (size["largest"] or 0) * (size["anchor"] or 0)
    primes = enough_primes(bound)
    count = size["anchors"]

    everything = [F.array(F.lit(v)).alias(n) for n, v in (("low", -bound), ("high", bound))]
    anchors = rows.where(is_anchor)
    near = _search(rows, anchors.select("*", *everything), count, width, primes, positives, True)
    near = stored(near, "positives")

    windows = near.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p")
    )
    # From ``positives`` on places are filled with an empty window.
    score = lambda i: F.get(F.col("p.score"), F.lit(i))
    per_cent = lambda i, share: F.lit(share) * score(i).cast("decimal(38,0)") / 100
    low = [F.coalesce(F.ceil(per_cent(i, least)).cast("bigint"), F.lit(bound)) for i in range(positives)]
    high = [F.coalesce(F.floor(per_cent(i, most)).cast("bigint"), F.lit(-bound - 1)) for i in range(positives)]
    windowed = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "q", F.array(*low).alias("low"), F.array(*high).alias("high")
    )
    hard = _search(rows, windowed, count, width, primes, negatives, False)
    positive = near.select(
        F.col("anchor_id").alias("of"),
        (F.col("place") - 1).alias("of_slot"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    joined = hard.join(positive, (F.col("anchor_id") == F.col("of")) & (F.col("slot") == F.col("of_slot")))
    return joined.select(
        "anchor_id",
        "positive_id",
        F.col("place").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
