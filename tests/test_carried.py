"""Loads one after the other against one run over all sales."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from starmart.carried import balances, months, reports
from starmart.carried.parts import Parts
from starmart.config import Config
from starmart.operators import cumulative, trend
from starmart.plans.customer_behavior import customer_behavior
from starmart.plans.product_performance import product_performance
from starmart.schema import Star
from starmart.sources import tpch
from tests.conftest import DATA
from tests.rows import listed, sale, star

CONFIG = tpch.TPCH_CONFIG


@pytest.fixture(scope="module")
def whole(spark):
    return tpch.star(spark, f"{DATA}/sf0.001")


def by_day(sales):
    """Three loads, each of later days than the one before; undated sales in the last."""
    year = F.coalesce(F.year("order_date"), F.lit(9999))
    return [sales.where(year < 1998), sales.where((year >= 1998) & (year < 2000)), sales.where(year >= 2000)]


def by_order(sales):
    """Three loads that cut days, months and customers."""
    part = F.pmod(F.xxhash64("order_number"), F.lit(3))
    return [sales.where(part == i) for i in range(3)]


def same(rows, expected):
    assert rows.dtypes == expected.dtypes
    assert sorted(listed(rows), key=repr) == sorted(listed(expected), key=repr)


@pytest.mark.parametrize("cut", [by_day, by_order])
def test_running_spend(spark, whole, tmp_path, cut):
    root = str(tmp_path)
    for i, part in enumerate(cut(whole.sales)):
        assert balances.add_load(spark, root, part) == i + 1
    same(balances.customer_spend(spark, root), cumulative.customer_spend(whole, CONFIG))


def test_a_load_in_order_reads_only_its_own_sales(spark, whole, tmp_path, monkeypatch):
    root = str(tmp_path)
    read = []
    plain = Parts.read

    def noted(self, table, schema):
        read.append(table)
        return plain(self, table, schema)

    monkeypatch.setattr(Parts, "read", noted)
    for part in by_day(whole.sales):
        balances.add_load(spark, root, part)
    assert set(read) == {"balances"}


def test_late_and_missing_sales(spark, tmp_path):
    root = str(tmp_path)
    loads = [
        [sale("1", day="2013-05-01"), sale("2", day="2013-05-03", amount=None), sale("3", customer=None)],
        [sale("4", day="2013-05-02", amount=7), sale("5", customer=2, amount=None), sale("6", day=None)],
        [],
        [sale("7", customer=2, day="2014-01-01"), sale("8", customer=None, day="2012-01-01"), sale("1", day="2013-05-01")],
    ]
    for load in loads:
        balances.add_load(spark, root, star(spark, sales=load).sales)
    together = star(spark, sales=[row for load in loads for row in load])
    same(balances.customer_spend(spark, root), cumulative.customer_spend(together, Config()))


def test_nothing_loaded(spark, tmp_path):
    assert balances.customer_spend(spark, str(tmp_path)).collect() == []
    assert months.scorecard(spark, str(tmp_path), order_year=F.year("month")).collect() == []


@pytest.mark.parametrize("cut", [by_day, by_order])
def test_months(spark, whole, tmp_path, cut):
    root = str(tmp_path)
    for part in cut(whole.sales):
        months.add_load(spark, root, part)
    for expected, parts in (
        (trend.annual_scorecard, {"order_year": F.year("month")}),
        (trend.calendar_month, {"order_month": F.month("month")}),
        (trend.year_month, {"order_year": F.year("month"), "order_month": F.month("month")}),
        (trend.month_start, {"order_date": F.col("month")}),
    ):
        full = expected(whole, CONFIG)
        same(months.scorecard(spark, root, **parts).select(*full.columns), full)


def test_years_read_months_and_no_sales(spark, whole, tmp_path, capsys):
    root = str(tmp_path)
    months.add_load(spark, root, whole.sales)
    capsys.readouterr()
    months.scorecard(spark, root, order_year=F.year("month")).explain("formatted")
    text = capsys.readouterr().out
    assert "bitmap_or_agg" in text and "fact_sales" not in text and "customer_key" not in text


def test_numbers_are_dense_and_stay(spark, tmp_path):
    root = str(tmp_path)
    keys = [-5, 0, 10**15, 7, 8, 9, 7]
    for day, some in (("2013-01-01", keys[:4]), ("2013-02-01", keys)):
        sold = [sale(str(k), customer=k, product=k and -k, day=day) for k in some]
        months.add_load(spark, root, star(spark, sales=[*sold, sale("x", customer=None, product=None, day=day)]).sales)
    ids = Parts(spark, root).read("ids", months.IDS)
    for item in (1, 2):
        found = {r.key: (r.id, r.load) for r in ids.where(F.col("item") == item).collect()}
        assert sorted(i for i, _ in found.values()) == list(range(1, 7))
        assert {k for k, (i, load) in found.items() if load == 1} == {k if item == 1 else -k for k in keys[:4]}
        assert {i for i, load in found.values() if load == 1} == {1, 2, 3, 4}


@pytest.mark.parametrize("cut", [by_day, by_order])
@pytest.mark.parametrize("compacted", [False, True])
def test_reports(spark, whole, tmp_path, cut, compacted):
    root = str(tmp_path)
    for part in cut(whole.sales):
        reports.add_load(spark, root, part, CONFIG)
        if compacted:
            reports.compact(spark, root, CONFIG)
            assert len(Parts(spark, root).listed()) == 1
    same(reports.product_report(spark, root, whole.products, CONFIG), product_performance(whole, CONFIG))
    dims = Star(None, whole.customers, whole.products)
    same(reports.customer_report(spark, root, dims, CONFIG), customer_behavior(whole, CONFIG))


def test_a_part_that_fails_is_not_read(spark, whole, tmp_path):
    root = str(tmp_path)
    months.add_load(spark, root, whole.sales)
    before = sorted(listed(months.scorecard(spark, root, order_year=F.year("month"))))
    broken = whole.sales.withColumn("sales_amount", F.expr("raise_error('lost')").cast("int"))
    with pytest.raises(Exception, match="lost"):
        months.add_load(spark, root, broken)
    assert sorted(listed(months.scorecard(spark, root, order_year=F.year("month")))) == before
    assert months.add_load(spark, root, whole.sales.limit(0)) == 2
