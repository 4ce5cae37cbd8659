"""Lookups that keep frequent keys apart, against plain joins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from starmart.operators import heavy
from starmart.registry import OPERATORS
from starmart.schema import Star
from starmart.sources import tpch
from tests.conftest import DATA
from tests.rows import listed

CONFIG = tpch.TPCH_CONFIG


@pytest.fixture
def large(monkeypatch):
    """Every dimension counts as too large to be broadcast whole."""
    monkeypatch.setattr(heavy, "SMALL_DIMENSION", -1)


def rows(spark, seed):
    """A third of the rows under a known key, some under an unknown one and under null."""
    draw = random.Random(seed)
    key = lambda: draw.choice([1, 1, -9, None, draw.randrange(400)])
    made = [(key(), f"o{draw.randrange(900)}") for _ in range(3000)]
    return spark.createDataFrame(made, "k bigint, item string")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize(("seed", "share"), [(1, 0.001), (2, 0.1), (3, 0.9)])
def test_the_same_as_a_plain_join(spark, large, monkeypatch, how, seed, share):
    monkeypatch.setattr(heavy.heavy_keys, "__defaults__", (share,))
    left = rows(spark, seed)
    dimension = spark.range(300).selectExpr("id as k", "if(id % 7 = 0, null, concat('n', id)) as name", "id * 2 as more")
    expected = left.join(dimension, "k", how)
    found = heavy.looked_up(left, "k", dimension, left, F.col("item"), how)
    assert found.dtypes == expected.dtypes
    assert sorted(listed(found), key=repr) == sorted(listed(expected), key=repr)


def test_heavy_keys_are_few(spark):
    found = heavy.heavy_keys(rows(spark, 4), "k")
    keys = {r.k for r in found.collect()}
    assert {1, -9} <= keys and len(keys) <= 1000 and None not in keys
    assert {r.k for r in heavy.heavy_keys(rows(spark, 4), "k", 0.1).collect()} == {1, -9}
    assert heavy.heavy_keys(spark.createDataFrame([], "k bigint"), "k").collect() == []


def test_no_task_gets_a_heavy_key_whole(spark, large):
    """What the join deals out by is spread evenly, although one key has 40 % of the rows."""
    left = rows(spark, 5)
    dimension = spark.range(300).selectExpr("id as k", "id as name")
    joined = heavy.looked_up(left, "k", dimension, left, F.col("item"))
    tree = joined._jdf.queryExecution().analyzed().toString()
    assert "xxhash64" in tree
    listing = heavy.heavy_keys(left, "k").collect()
    light = F.col("k").isNotNull() & ~F.col("k").isin([r.k for r in listing])
    dealt = left.select(F.when(light, F.col("k")).otherwise(F.xxhash64("item")).alias("d"))
    parts = dealt.groupBy(F.pmod(F.hash("d"), F.lit(8))).count().collect()
    assert max(r["count"] for r in parts) < 2 * left.count() / 8


NAMES = ["mag_orders_by_country", "share_orders_by_category", "share_customer_penetration"]
NAMES += ["bottom3_customers_orders", "customer_behavior"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("hot_key", [42, -42, None])
def test_operators_with_hot_keys(spark, monkeypatch, name, hot_key):
    star = tpch.star(spark, f"{DATA}/sf0.001")
    hot = F.when(F.pmod(F.xxhash64("order_number"), F.lit(3)) == 0, F.lit(hot_key))
    sales = star.sales.withColumn("customer_key", hot.otherwise(F.col("customer_key")))
    sales = sales.withColumn("product_key", F.when(F.col("price") % 3 == 0, F.lit(77)).otherwise(F.col("product_key")))
    skewed = Star(sales, star.customers, star.products)
    expected = listed(OPERATORS[name](skewed, CONFIG))
    monkeypatch.setattr(heavy, "SMALL_DIMENSION", -1)
    assert sorted(listed(OPERATORS[name](skewed, CONFIG)), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_large_dimensions_split_by_default(spark, large, capsys, name):
    """With all of Spark's thresholds as they are, the plan holds the broadcast of heavy keys."""
    star = tpch.star(spark, f"{DATA}/sf0.001")
    capsys.readouterr()
    OPERATORS[name](star, CONFIG).explain()
    text = capsys.readouterr().out
    assert "_heavy" in text and "BroadcastExchange" in text
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Expand"):
        assert node not in text


def test_small_dimensions_are_joined_plainly(spark, capsys):
    star = tpch.star(spark, f"{DATA}/sf0.001")
    assert not heavy.is_large(star.customers) and not heavy.is_large(spark.range(5).toDF("k"))
    OPERATORS["mag_orders_by_country"](star, CONFIG).explain()
    assert "_heavy" not in capsys.readouterr().out
