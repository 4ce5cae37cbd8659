"""Documents that are longer than what their source's whole copies leave open."""

from __future__ import annotations

import pytest

from starmart.llm import mixing

ROW = "group string, doc_id bigint, key bigint, size bigint, expected double"


def _taken(spark, rows, seed):
    taken: dict[str, int] = {}
    for row in mixing.pareto_sample(spark.createDataFrame(rows, ROW), seed=seed, buckets=64).collect():
        taken[row["group"]] = taken.get(row["group"], 0) + row["copies"] * row["size"]
    return taken


def test_sources_of_one_document(spark):
    shares = [0.0, 0.2, 0.99, 1.0, 1.3, 1.99, 2.6]
    rows = [(f"g{i}", i, i * 7919 + 1, 1_000, share) for i, share in enumerate(shares)]
    rows += [(f"g{i}", 100 + i, i, 0, share) for i, share in enumerate(shares)]
    found = _taken(spark, rows, 0)
    assert [found[f"g{i}"] for i in range(len(shares))] == [0, 0, 1_000, 1_000, 1_000, 2_000, 3_000]


@pytest.mark.parametrize("seed", range(2))
def test_one_dominating_text(spark, seed):
    rows = [(f"g{g}", 0, g * 7919 + 1, 1_000_000, 0.9) for g in range(8)]
    rows += [(f"g{g}", i, (g * 101 + i) * 104729, 1_000, 0.9) for g in range(8) for i in range(1, 101)]
    for taken in _taken(spark, rows, seed).values():
        assert taken == 1_000_000


def test_small_ones_fill_what_a_long_one_leaves(spark):
    rows = [(f"g{g}", 0, g * 7919 + 1, 10_000, 0.1) for g in range(8)]
    rows += [(f"g{g}", i, (g * 101 + i) * 104729, 10, 0.1) for g in range(8) for i in range(1, 101)]
    for taken in _taken(spark, rows, 0).values():
        assert taken == pytest.approx(1_000, abs=100)


def test_two_long_documents_end_on_the_nearer_side(spark):
    rows = [("g", 0, 5, 10_000, 0.1), ("g", 1, 6, 1_600, 0.1)]
    for seed in range(2):
        assert _taken(spark, rows, seed) == {"g": 1_600}
