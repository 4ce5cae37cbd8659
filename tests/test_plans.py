"""Shapes of the physical plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from starmart.operators import spread
from starmart.registry import OPERATORS
from starmart.schema import Star
from starmart.sources import tpch
from tests.conftest import DATA

CONFIG = tpch.TPCH_CONFIG


@pytest.fixture(scope="module")
def stored(spark):
    return tpch.star(spark, f"{DATA}/sf0.001")


def plan(rows, capsys) -> str:
    capsys.readouterr()
    rows.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["rank_customers_in_year", "time_period_products"])
def test_period_reaches_the_files(stored, capsys, name):
    text = plan(OPERATORS[name](stored, CONFIG), capsys)
    assert re.search(r"PartitionFilters: \[.*order_year.*>= 200[01]", text)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(order_date,", text)


@pytest.mark.parametrize("name", ["rank_products_per_year", "dense_rank_products_per_year"])
def test_values_are_trimmed_before_they_are_ranked(stored, capsys, name):
    assert plan(OPERATORS[name](stored, CONFIG), capsys).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize(
    "name", ["rank_customers_in_year", "dense_rank_customers_in_year", "top5_products_ranked"]
)
def test_values_of_one_group_are_cut_to_a_short_list(stored, capsys, name):
    assert "TakeOrderedAndProject" in plan(OPERATORS[name](stored, CONFIG), capsys)


@pytest.mark.parametrize(
    "name", ["top5_products", "bottom5_products", "top10_customers", "bottom3_customers_orders"]
)
def test_short_lists_need_no_full_sort(stored, capsys, name):
    assert "TakeOrderedAndProject" in plan(OPERATORS[name](stored, CONFIG), capsys)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_python_no_cross_join_no_row_multiplication(stored, capsys, name):
    text = plan(OPERATORS[name](stored, CONFIG), capsys)
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Expand"):
        assert node not in text


# What may be brought into one task: partial totals, one row per slice, per
# calendar period, per category or per subcategory.
SMALL = re.compile(r"keys=\[(_slice|category|subcategory|_groupingexpression)?(#\d+)?\]")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_task_never_gets_unbounded_rows(stored, capsys, monkeypatch, name):
    # Full ranks count their values first; here there are more than a window may hold.
    monkeypatch.setattr(spread, "SLICE_VALUES", 50)
    rows = OPERATORS[name](stored, CONFIG)
    capsys.readouterr()
    rows.explain()
    lines = capsys.readouterr().out.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = next(text for text in lines[i:] if "HashAggregate" in text)
            assert SMALL.search(below), below


def test_scans_read_only_what_is_used(stored, capsys):
    text = plan(OPERATORS["mag_revenue_by_country"](stored, CONFIG), capsys)
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert sorted(schemas) == [
        "customer_key:bigint,country:string",
        "customer_key:bigint,sales_amount:int",
    ]


def test_sales_are_reduced_before_they_meet_a_dimension(stored, capsys):
    text = plan(OPERATORS["mag_revenue_by_country"](stored, CONFIG), capsys)
    tree = text.split("\n\n")[0]
    join = next(i for i, line in enumerate(tree.splitlines()) if "Join" in line)
    assert any("HashAggregate" in line for line in tree.splitlines()[join + 1 :])


@pytest.mark.parametrize("name", ["share_orders_by_category", "share_customer_penetration"])
def test_pairs_are_distinct_before_they_meet_the_catalogue(stored, capsys, name):
    rows = OPERATORS[name](stored, CONFIG)
    capsys.readouterr()
    rows.explain()
    lines = capsys.readouterr().out.splitlines()
    sold = next(i for i, x in enumerate(lines) if "Scan parquet" in x and "product_key" in x and "category" not in x)
    above = [x for x in lines[:sold] if "HashAggregate" in x or "Join" in x]
    assert "HashAggregate(keys=[product_key" in above[-1] and "HashAggregate" in above[-2]


def test_product_units_use_two_shuffles(stored, capsys):
    tree = plan(OPERATORS["cum_product_units"](stored, CONFIG), capsys).split("\n\n")[0]
    assert len(re.findall(r"Exchange", tree)) == 2


def test_spend_windows_hold_a_day_or_the_calendar(stored, capsys):
    """Rows meet by customer and day; only day totals are brought together by customer."""
    tree = plan(OPERATORS["cum_customer_spend"](stored, CONFIG), capsys).split("\n\n")[0]
    rows = OPERATORS["cum_customer_spend"](stored, CONFIG)
    rows.explain()
    lines = capsys.readouterr().out.splitlines()
    windows = [re.search(r"\], \[(spender.*?)\], \[(\w+)", x) for x in lines if "Window [" in x]
    parts = sorted((re.sub(r"#\d+L?", "", w[1]), w[2]) for w in windows)
    assert parts == [
        ("spender, known", "order_date"),
        ("spender, known, order_date", "order_number"),
    ]
    assert "SinglePartition" not in "".join(lines) and len(re.findall("Scan parquet", tree)) == 2


@pytest.mark.parametrize("name", ["rank_products_profit", "rank_products_in_quarter"])
def test_full_ranks_read_the_sales_once(spark, stored, capsys, monkeypatch, name):
    """One scan of the sales fills a table; the rank itself reads that table only."""
    evaluated = []
    kept = spread.kept

    def noted(rows, label):
        evaluated.append(plan(rows, capsys))
        return kept(rows, label)

    monkeypatch.setattr(spread, "kept", noted)
    text = plan(OPERATORS[name](stored, CONFIG), capsys)
    sales = re.compile(r"fact_sales")
    assert not sales.search(text)
    assert sum(len(sales.findall(x)) for x in evaluated) == 1


@pytest.mark.parametrize("name", ["top10_customers", "rank_customers_in_year"])
def test_names_are_joined_to_the_short_list(stored, capsys, name):
    rows = OPERATORS[name](stored, CONFIG)
    capsys.readouterr()
    rows.explain()
    lines = capsys.readouterr().out.splitlines()
    names = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "first_name" in line)
    joins = [line for line in lines[:names] if "Join" in line]
    cut = [i for i, line in enumerate(lines) if "TakeOrdered" in line or "GlobalLimit" in line]
    assert len(joins) >= 1 and cut
    below = [line for line in lines if "Scan parquet" in line and "first_name" in line]
    assert len(below) == 1


@pytest.mark.parametrize(
    "name",
    [
        "mag_orders_by_country",
        "share_orders_by_category",
        "bottom3_customers_orders",
        "customer_behavior",
    ],
)
@pytest.mark.parametrize("hot_key", [42, -42, None])
def test_hot_keys_are_split_when_dimensions_are_large(spark, stored, capsys, name, hot_key):
    """With every join shuffled and a third of the rows on one key, joins split it.

    The key is a known one, one that no dimension has, or NULL.
    """
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    sales = tpch.star(spark, f"{DATA}/sf0.01").sales
    draw = F.pmod(F.xxhash64("order_number", "product_key", "price"), F.lit(3))
    hot = sales.withColumn(
        "customer_key", F.when(draw == 0, F.lit(hot_key)).otherwise(F.col("customer_key"))
    ).withColumn("product_key", F.when(draw == 1, F.lit(77)).otherwise(F.col("product_key")))
    skewed = Star(hot, stored.customers, stored.products)
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = OPERATORS[name](skewed, CONFIG)
        rows.collect()
        assert "skewJoin=true" in plan(rows, capsys) or "skew=true" in plan(rows, capsys)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
