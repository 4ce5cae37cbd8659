"""Traps of single operators on hand-written rows."""

from __future__ import annotations

from datetime import date

import pytest

from starmart.config import Config
from starmart.operators import cumulative, explore, magnitude, ranking, share, trend
from starmart.operators.segment import cost_ranges, customer_segments
from starmart.registry import OPERATORS
from tests.rows import customer, listed, product, sale, star

CONFIG = Config()


def test_never_sold_counts_a_path_not_a_product(spark):
    s = star(
        spark,
        sales=[sale("1", product=1)],
        products=[product(1), product(2), product(3, name="other")],
    )
    assert listed(magnitude.never_sold(s, CONFIG)) == [("other", "Bikes", "Road")]
    assert sorted(listed(magnitude.sold_status(s, CONFIG))) == [
        ("other", "Bikes", "Road", 0, "Unsold"),
        ("thing", "Bikes", "Road", 1, "Sold"),
    ]


def test_unmatched_sales_keep_their_own_group(spark):
    s = star(
        spark,
        sales=[sale("1", customer=1), sale("2", customer=9, amount=5), sale("2", customer=None)],
        customers=[customer(1)],
    )
    assert sorted(listed(magnitude.revenue_by_country(s, CONFIG)), key=repr) == [
        ("Peru", 10),
        (None, 15),
    ]
    # Two unknown customers on one order: one order.
    assert dict(listed(magnitude.orders_by_country(s, CONFIG))) == {"Peru": 1, None: 1}


def test_kpis_use_distinct_orders_and_names(spark):
    s = star(
        spark,
        sales=[sale("1", price=1), sale("1", price=2), sale("2", price=2)],
        customers=[customer(1), customer(2)],
        products=[product(1), product(2), product(3, name="other")],
    )
    assert listed(explore.kpi_report(s, CONFIG)) == [
        ("Total Sales", 30),
        ("Total Quantity", 3),
        ("Average Price", 1),
        ("Total Orders", 2),
        ("Total Products", 2),
        ("Total Customers", 2),
    ]


def test_age_range_uses_the_snapshot(spark):
    s = star(
        spark,
        customers=[
            customer(1, birthdate=date(1950, 12, 31)),
            customer(2, birthdate=date(2000, 1, 1)),
            customer(3),
        ],
    )
    assert listed(explore.customer_age_range(s, CONFIG)) == [
        (date(1950, 12, 31), 64, date(2000, 1, 1), 14)
    ]


def test_rank_keeps_ties_and_dense_rank_leaves_no_gap(spark):
    sales = [
        sale(str(i), customer=i, day="2014-01-05", amount=100 - 10 * (i // 2)) for i in range(30)
    ]
    s = star(spark, sales=sales, customers=[customer(i) for i in range(30)])
    ranks = sorted(r.rank_customers for r in ranking.customers_in_year(s, CONFIG).collect())
    dense = sorted(
        r.dense_rank_customers for r in ranking.customers_in_year_dense(s, CONFIG).collect()
    )
    assert ranks == [1, 1, 3, 3, 5, 5, 7, 7, 9, 9]
    assert dense == sorted([*range(1, 11)] * 2)


def test_all_ties_stay_whatever_their_number(spark):
    sales = [sale(str(i), customer=i, day="2014-01-05", amount=7) for i in range(30)]
    s = star(spark, sales=sales, customers=[customer(i) for i in range(30)])
    for rank in (ranking.customers_in_year, ranking.customers_in_year_dense):
        rows = rank(s, CONFIG).collect()
        assert len(rows) == 30 and {row[-1] for row in rows} == {1}


def test_profit_ignores_sales_without_cost(spark):
    s = star(
        spark,
        sales=[sale("1", product=1, quantity=2), sale("2", product=2)],
        products=[product(1, cost=3), product(2, cost=None)],
    )
    assert listed(ranking.products_by_profit(s, CONFIG)) == [("thing", 14, 1)]


def test_lists_put_the_unknown_product_in_competition(spark):
    s = star(
        spark,
        sales=[sale("1", product=1, amount=3), sale("2", product=9, amount=50)],
        products=[product(1)],
    )
    assert listed(ranking.top_products(s, CONFIG)) == [(None, 50), ("thing", 3)]
    assert listed(ranking.bottom_products(s, CONFIG)) == [("thing", 3), (None, 50)]


def test_peers_share_the_running_total(spark):
    s = star(
        spark,
        sales=[
            sale("A", amount=1),
            sale("A", amount=2),
            sale("B", amount=4),
            sale("C", amount=8, day="2013-06-16"),
            sale("D", amount=16, day=None),
        ],
    )
    rows = [(r.order_number, r.cumulative_spend) for r in
            cumulative.customer_spend(s, CONFIG).collect()]
    assert sorted(rows) == [("A", 3), ("A", 3), ("B", 7), ("C", 15)]


def test_running_means_are_means_of_truncated_means(spark):
    s = star(
        spark,
        sales=[
            sale("1", day="2012-05-01", price=1),
            sale("2", day="2012-05-02", price=2),
            sale("3", day="2013-05-02", price=4),
        ],
    )
    assert listed(cumulative.annual(s, CONFIG)) == [
        (date(2012, 1, 1), 20, 20, 1),
        (date(2013, 1, 1), 10, 30, 2),
    ]


def test_months_without_a_date_can_win(spark):
    s = star(spark, sales=[sale("1", day=None, amount=1), sale("2", amount=5)])
    assert listed(trend.worst_month(s, CONFIG)) == [(None, 1)]
    assert listed(trend.best_month(s, CONFIG)) == [(6, 5)]


def test_seasonal_mix_weighs_cost_by_sales_rows(spark):
    s = star(
        spark,
        sales=[sale("1"), sale("2"), sale("3", product=2), sale("4", product=9)],
        products=[product(1, cost=10), product(2, cost=1)],
    )
    assert listed(trend.seasonal_mix(s, CONFIG)) == [(6, 7, 3, 4)]


def test_label_is_text_in_calendar_order(spark):
    s = star(spark, sales=[sale("1", day="2013-12-05"), sale("2", day="2013-04-05")])
    labels = [r.order_date_label for r in trend.month_label(s, CONFIG).collect()]
    assert labels == ["2013-Apr", "2013-Dec"]


def test_scorecard_counts_known_keys_once_per_year(spark):
    s = star(
        spark,
        sales=[sale("1"), sale("2", product=2), sale("3", customer=2), sale("4", customer=None)],
    )
    assert listed(trend.annual_scorecard(s, CONFIG)) == [(2013, 40, 2, 4, 2)]


def test_shares(spark):
    s = star(
        spark,
        sales=[
            sale("1", product=1),
            sale("1", product=2),
            sale("2", product=2, customer=2),
            sale("3", product=4, customer=3),
        ],
        products=[
            product(1, category="Bikes"),
            product(2, category="Caps"),
            product(3, category="Bells"),
            product(4, category=None),
        ],
    )
    assert sorted(listed(share.sales_by_category(s, CONFIG))) == [
        ("Bikes", 10, 30, "33.33%"),
        ("Caps", 20, 30, "66.67%"),
    ]
    assert sorted(listed(share.orders_by_category(s, CONFIG))) == [
        ("Bikes", 1, 3, "33.33%"),
        ("Caps", 2, 3, "66.67%"),
    ]
    assert sorted(listed(share.customer_penetration(s, CONFIG))) == [
        ("Bells", 0, 3, "0%"),
        ("Bikes", 1, 3, "33.33%"),
        ("Caps", 2, 3, "66.67%"),
    ]


def test_cost_ranges_at_their_bounds(spark):
    costs = [0, 99, 100, 500, 501, 1000, 1001, None]
    s = star(spark, products=[product(i, cost=c) for i, c in enumerate(costs)])
    assert dict(listed(cost_ranges(s, CONFIG))) == {
        "Below 100": 2,
        "100-500": 2,
        "500-1000": 2,
        "Above 1000": 2,
    }


# Snapshot 2014-01-28: (first order, last order, spend) -> segment.
ACCOUNTS = [
    ("2013-01-31", "2013-11-01", 5001, "Core VIP (Established)"),
    ("2013-01-31", "2013-11-01", 5000, "Regular"),
    ("2013-02-01", "2013-11-01", 5001, "Regular"),
    ("2013-01-31", "2013-10-31", 5001, "Regular"),
    ("2013-10-01", "2013-11-01", 5001, "New VIP (Shooting Star)"),
    ("2013-10-01", "2013-11-01", 5000, "New Account (Growth Driver)"),
    ("2013-10-01", "2013-11-01", 1000, "New Account (Growth Driver)"),
    ("2013-10-01", "2013-11-01", 999, "Standard New (Low Spend)"),
    ("2013-10-01", "2013-10-31", 9999, "Cold New Lead"),
    ("2013-09-30", "2013-10-31", 10, "Regular"),
    ("2012-01-01", "2013-01-31", 9999, "Lost / Inactive"),
    ("2012-01-01", "2013-02-01", 9999, "At Risk / Slipping"),
    ("2012-01-01", "2013-09-30", 9999, "At Risk / Slipping"),
    ("2014-02-10", "2014-02-10", 10, "Standard New (Low Spend)"),
]


@pytest.mark.parametrize(("first", "last", "spend", "segment"), ACCOUNTS)
def test_segments_at_their_bounds(spark, first, last, spend, segment):
    s = star(
        spark,
        sales=[sale("1", day=first, amount=spend - 1), sale("2", day=last, amount=1)],
        customers=[customer(1)],
    )
    assert listed(customer_segments(s, CONFIG)) == [(segment, 1)]


def test_unknown_customers_are_a_group_that_counts_nobody(spark):
    s = star(spark, sales=[sale("1", customer=7, day="2012-01-01")])
    assert listed(customer_segments(s, CONFIG)) == [("Lost / Inactive", 0)]


def test_texts_can_be_compared_without_case(spark):
    s = star(
        spark,
        sales=[sale("so1"), sale("SO1 ", customer=2), sale("SO2", customer=2)],
        customers=[customer(1, country="Peru"), customer(2, country="PERU ")],
        products=[product(1, name="Cap"), product(2, name="cap")],
    )
    plain, folded = (magnitude.orders_by_country(t, CONFIG) for t in (s, s.collated()))
    assert sorted(listed(plain)) == [("PERU ", 2), ("Peru", 1)]
    assert [row.total_orders for row in folded.collect()] == [2]
    names = dict(listed(explore.kpi_report(s.collated(), CONFIG)))
    assert (names["Total Orders"], names["Total Products"]) == (2, 1)


def test_every_operator_runs_on_collated_texts(spark):
    s = star(
        spark,
        sales=[sale("1"), sale("2", product=9, customer=9), sale("3", day=None)],
        customers=[customer(1)],
        products=[product(1), product(2, category=None)],
    ).collated()
    for operator in OPERATORS.values():
        operator(s, CONFIG).collect()
