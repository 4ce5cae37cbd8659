"""Relations that must hold between results on generated data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from starmart.functions import labels
from starmart.registry import OPERATORS
from starmart.sources import tpch
from tests.conftest import DATA

CONFIG = tpch.TPCH_CONFIG


@pytest.fixture(scope="module")
def stored(spark):
    return tpch.star(spark, f"{DATA}/sf0.01")


def rows(stored, name):
    return OPERATORS[name](stored, CONFIG)


def total(stored, name, column):
    return rows(stored, name).agg(F.sum(column)).first()[0]


def test_last_running_total_is_the_total(stored):
    for name in ("cum_annual", "cum_monthly"):
        sums = rows(stored, name).agg(F.sum("total_sales"), F.max("running_total_sales")).first()
        assert sums[0] == sums[1]


def test_groupings_add_up_to_all_sales(stored):
    everything = rows(stored, "measure_total_sales").first()[0]
    assert total(stored, "mag_revenue_by_country", "total_sales_amount") == everything
    assert total(stored, "mag_revenue_by_product", "total_sales_amount") == everything
    assert total(stored, "mag_revenue_by_category", "total_revenue") == everything
    assert total(stored, "mag_revenue_by_customer", "total_revenue") == everything


def test_shares_use_the_shown_rows(stored):
    first = rows(stored, "share_sales_by_category").first()
    assert total(stored, "share_sales_by_category", "total_sales") == first.overall_sales


def test_segments_partition_the_customers_of_the_report(stored):
    known = rows(stored, "customer_behavior").where("customer_key is not null").count()
    assert total(stored, "segment_customers", "total_customers") == known


def test_customer_spend_keeps_every_dated_row(stored):
    assert rows(stored, "cum_customer_spend").count() == stored.sales.where(
        "order_date is not null"
    ).count()


def test_rank_is_at_least_dense_rank(stored):
    key = ["sales_year", "product_key"]
    both = rows(stored, "rank_products_per_year").join(
        rows(stored, "dense_rank_products_per_year"), key
    )
    assert both.where("rank_products < dense_rank_products").isEmpty()


def test_sentinels_never_fire(stored):
    customers, products = rows(stored, "customer_behavior"), rows(stored, "product_performance")
    assert customers.where(
        F.col("detailed_customer_segment") == labels.UNSEGMENTED
    ).isEmpty()
    assert products.where(
        F.col("product_obsolescence_status") == labels.UNMAPPED_SALE
    ).isEmpty()


def test_every_other_branch_is_reached(stored):
    customers, products = rows(stored, "customer_behavior"), rows(stored, "product_performance")
    expected = {
        "detailed_customer_segment": 9,
        "age_groups": 6,
        "customer_loyalty_tier": 3,
    }
    for column, count in expected.items():
        assert customers.select(column).distinct().count() == count
    expected = {
        "product_obsolescence_status": 5,
        "lifetime_sales_tier": 3,
        "product_margin_segment": 6,
        "product_profit_volume_segment": 5,
    }
    for column, count in expected.items():
        assert products.select(column).distinct().count() == count


def test_reports_hold_every_product_and_every_buyer(stored):
    sold = stored.sales.where("order_date is not null").select("product_key")
    keys = stored.products.select("product_key").union(sold).distinct().count()
    assert rows(stored, "product_performance").count() == keys
    report = rows(stored, "customer_behavior").select("customer_key")
    assert report.count() == report.distinct().count()
