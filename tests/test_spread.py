"""Sliced ranks against plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starmart.operators import spread


def _ranked_input(spark, seed, distinct, hot):
    draw = random.Random(seed)
    rows = []
    for key in range(2000):
        group = draw.choice(["a", "b", None]) if draw.random() < 0.6 else "a"
        value = 7 if draw.random() < hot else draw.choice([None, *range(distinct)])
        rows.append((group, key, value))
    return spark.createDataFrame(rows, "g string, k int, v bigint")


@pytest.mark.parametrize("slice_values", [1, 70, 100_000])
@pytest.mark.parametrize(("seed", "distinct", "hot"), [(0, 10, 0.4), (1, 900, 0.34), (2, 5000, 0.0), (0, 1, 1.0)])
def test_rank_equals_window(spark, seed, distinct, hot, slice_values):
    rows = _ranked_input(spark, seed, distinct, hot)
    for by in ([], ["g"]):
        plain = Window.partitionBy(F.lit(0), *by).orderBy(F.desc("v"))
        expected = rows.withColumn("r", F.rank().over(plain).cast("bigint"))
        actual = spread.rank_descending(rows, "v", "r", by=by, slice_values=slice_values)
        assert actual.columns == expected.columns
        assert sorted(actual.collect(), key=repr) == sorted(expected.collect(), key=repr)


def test_no_rows_have_no_ranks(spark):
    rows = spark.createDataFrame([], "g string, v bigint")
    assert spread.rank_descending(rows, "v", "r", by=["g"]).collect() == []


def test_boundaries_follow_the_number_of_values(spark):
    rows = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("v"))
    for slices in (2, 64, 300):
        bounds = spread.boundaries(rows, "v", slices)
        assert slices / 2 < len(bounds) + 1 <= slices and bounds == sorted(bounds)
    assert spread.boundaries(rows, "v", 1) == []
    assert spread.boundaries(rows.where("v < 0"), "v", 64) == []


def test_windows_hold_no_more_values_than_allowed(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v"))
    bounds = spread.boundaries(rows, "v", 40)
    sizes = rows.groupBy(spread._slice("v", bounds)).count().agg(F.max("count")).first()[0]
    assert sizes < 2 * 20_000 / 40


@pytest.mark.parametrize("slice_values", [50, 100_000])
def test_rows_are_evaluated_once(spark, slice_values):
    """Whatever is below the rows runs once; all else reads what was stored."""
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    rows = spark.range(3000).selectExpr("id % 700 as v").mapInArrow(count, "v bigint")
    assert spread.rank_descending(rows, "v", "r", slice_values=slice_values).count() == 3000
    assert counted.value == 3000
