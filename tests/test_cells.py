"""Cells: each kind is grouped by itself, with the same totals as plain distinct counts."""

import pytest
from pyspark.sql import functions as F

from starmart.operators.distincts import Cells


@pytest.mark.parametrize("carrier", [None, "a"])
def test_cells_group_each_kind_by_its_own_columns(spark, carrier):
    made = [(1, "x", 5, 2), (1, "x", 6, 3), (1, None, 6, 4), (None, "y", None, 5), (2, None, None, None), (1, "x", 5, 1)]
    rows = spark.createDataFrame(made, "g int, a string, b bigint, v int")
    cells = Cells({"g": F.col("g")}, {"v": (F.sum, F.col("v"))}, {"a": F.col("a"), "b": F.col("b")}, carrier)
    plain = rows.groupBy("g").agg(F.sum("v").alias("v"), F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b"))
    once = cells.of(rows)
    twice = cells.merged(cells.of(rows.where("v > 2")).unionAll(cells.of(rows.where("v <= 2 or v is null"))))
    assert {tuple(r) for r in cells.totals(once).collect()} == {tuple(r) for r in plain.collect()}
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in once.collect()}
    assert "Generate" not in once._jdf.queryExecution().optimizedPlan().toString()
