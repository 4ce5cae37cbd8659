"""Stores that are replaced while they are read, or whose load fails half way."""

from __future__ import annotations

import os

import pytest

from starmart import __main__ as program
from starmart.config import Config
from starmart.plans import views
from starmart.schema import Star
from starmart.sources import csv_files, storage, versions
from tests.rows import customer, product, sale, star


def _star(spark, amount):
    sales = [sale("1", amount=amount), sale("2", amount=amount, day="2014-02-01")]
    return star(spark, sales=sales, customers=[customer(1)], products=[product(1)])


def _total(s):
    return s.sales.agg({"sales_amount": "sum"}).first()[0]


def test_a_publication_that_fails_half_way(spark, tmp_path):
    root = str(tmp_path)
    storage.publish(_star(spark, 5), root)
    good = _star(spark, 8)
    failing = good.products.selectExpr("raise_error('disk full') as product_key", "product_id")
    with pytest.raises(Exception, match="disk full"):
        storage.publish(Star(good.sales, good.customers, failing), root)
    assert _total(storage.open_star(spark, root)) == 10
    storage.publish(good, root)
    assert _total(storage.open_star(spark, root)) == 16


def test_a_load_that_fails_half_way(spark, tmp_path):
    root, texts = str(tmp_path / "root"), tmp_path / "texts"
    for amount, name in ((5, "first"), (8, "second")):
        for table, rows in _star(spark, amount).tables().items():
            csv_files.export_csv(rows, table, str(texts / name / f"{table}.csv"))
    program.load(spark, str(texts / "first"), root)
    os.rename(texts / "second" / "fact_sales.csv", texts / "second" / "elsewhere.csv")
    with pytest.raises(Exception, match="fact_sales"):
        program.load(spark, str(texts / "second"), root)
    assert _total(program.opened(spark, root)) == 10


def test_readers_keep_the_version_that_they_opened(spark, tmp_path):
    root = str(tmp_path)
    storage.publish(_star(spark, 5), root)
    before = storage.open_star(spark, root)
    storage.publish(_star(spark, 8), root)
    assert _total(before) == 10 and _total(storage.open_star(spark, root)) == 16


def test_stored_reports_stay_if_new_ones_fail(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    views.materialise(_star(spark, 5), Config(), root)
    broken = lambda star, config: star.sales.selectExpr("raise_error('no report') as x")
    monkeypatch.setitem(views.REPORTS, "v_customer_behavior_report", broken)
    with pytest.raises(Exception, match="no report"):
        views.materialise(_star(spark, 8), Config(), root)
    monkeypatch.undo()
    for rows in views.stored(spark, root).values():
        assert {r.total_sales for r in rows.collect()} == {10}


def test_old_versions_are_removed_on_demand(spark, tmp_path):
    root = str(tmp_path)
    for amount in (1, 2, 3, 4):
        storage.publish(_star(spark, amount), root)
    assert [n for n, _ in versions.history(spark, root)] == [1, 2, 3, 4]
    gone = versions.expire(spark, root, keep=2)
    assert len(gone) == 2 and not any(os.path.exists(f"{root}/{folder}") for folder in gone)
    assert [n for n, _ in versions.history(spark, root)] == [3, 4]
    assert _total(storage.open_star(spark, root)) == 8
    with pytest.raises(ValueError, match="current version"):
        versions.expire(spark, root, keep=0)


def test_a_folder_without_a_version(spark, tmp_path):
    assert versions.history(spark, str(tmp_path / "none")) == []
    with pytest.raises(FileNotFoundError, match="no version"):
        storage.open_star(spark, str(tmp_path / "none"))
