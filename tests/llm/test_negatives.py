"""Hard negatives against plain integer arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmart.llm import hard_negatives

ROW = "vec_id bigint, embedding array<double>, label int"


def relabelled(vec_id, label):
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def plain(rows, step=50):
    used = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        row = (label, [math.floor(256 * x) for x in vector])
        used[vec_id] = min(used.get(vec_id, row), row)
    out = []
    for anchor, (label, q) in used.items():
        if anchor % step:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, other, strict=False)), i, of) for i, (of, other) in used.items() if i != anchor
        ]
        positives = sorted(s for s in scored if s[2] == label)[:5]
        for positive, i, _ in positives:
            fits = sorted(s for s in scored if s[2] != label and 50 * positive >= 100 * s[0] >= 95 * positive)
            out += [(anchor, i, n + 1, j, -positive, -s) for n, (s, j, _) in enumerate(fits[:3])]
    return sorted(out)


def mined(spark, rows, extra=()):
    frame = spark.createDataFrame(rows, ROW)
    for name in extra:
        frame = frame.withColumn(name, F.lit("x"))
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.vectors(frame, relabel=relabelled)).collect()))


def generated(scale, width=12, rows=400, seed=5):
    draw = random.Random(seed)
    # Few different components, so that many scores are equal.
    value = lambda: draw.choice([-1.0, -0.5, 0.0, 0.25, 0.75, 1.0]) * scale
    return [(i, [value() for _ in range(width)], draw.randrange(4)) for i in range(rows)]


@pytest.mark.parametrize("scale", [0.1, 3.0, 1e3, 1e5])
def test_scores_of_all_sizes(spark, scale):
    """From two primes and float32 up to more digits than a double has."""
    rows = generated(scale)
    assert mined(spark, rows) == plain(rows) != []


def test_odd_rows(spark):
    rows = generated(1.0)
    rows += [(None, [1.0] * 12, 1), (1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * 12, 2)]
    rows += [(1150, [float("inf")] * 12, 2), (1200, [0.5] * 12, None), (1250, [], 3), (1300, [1.0, 1.0], 0)]
    rows += [(1350, [1.0] * 30, 1), (-50, [0.9] * 12, 2), (-49, [0.8] * 12, 1), (50, [1.0] * 12, 3), rows[100], rows[7]]
    assert mined(spark, rows, ("q", "slot", "place", "score", "anchor_id", "low", "high", "row", "of")) == plain(rows)


def test_waves_and_blocks_change_nothing(spark, monkeypatch):
    rows = generated(1.0, rows=700)
    monkeypatch.setattr(hard_negatives, "WAVE_BYTES", 500)
    monkeypatch.setattr(hard_negatives, "TILE", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK", 17)
    monkeypatch.setattr(hard_negatives, "INNER", 5)
    assert mined(spark, rows) == plain(rows)


def test_one_label_or_none_left(spark):
    assert mined(spark, [(i, [1.0, 0.5], 1) for i in range(1, 60) if i % 7]) == []
    assert mined(spark, []) == []
    assert mined(spark, [(50, None, 1)]) == []


def test_scores_beyond_62_bits_are_refused(spark):
    with pytest.raises(ValueError, match="62 bits"):
        mined(spark, [(0, [1e9], 1), (1, [1e9], 2)])


@pytest.mark.parametrize("largest", [3, 200, 40_000, 2**28])
def test_signed_products(largest):
    draw = np.random.default_rng(largest)
    a, b = (draw.integers(-largest, largest + 1, (n, 30)) for n in (9, 14))
    a[0], b[0] = largest, -largest
    primes = hard_negatives.enough_primes(30 * largest**2)
    parts = hard_negatives.product(*(hard_negatives.residues(m, primes) for m in (a, b)), primes)
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert hard_negatives.signed(parts, primes).astype(object).tolist() == exact
