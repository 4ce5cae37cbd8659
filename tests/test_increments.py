"""CSV files that arrive one after the other."""

from __future__ import annotations

import os

import pytest

from starmart.carried import balances
from starmart.schema import PRODUCTS, SALES
from starmart.sources import csv_files, versions
from tests.rows import sale, star

GOOD = "{0},210,FR-{0},Frame,CO_RF,Components,Road Frames,Yes,0,Road,01/07/2003"


def put(folder, name, *lines, columns=PRODUCTS.names):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([",".join(columns), *lines]) + "\n")


def keys(spark, target):
    return sorted((r.product_key, r.load) for r in csv_files.added(spark, "dim_products", target).collect())


def test_a_repeated_load_reads_new_files_only(spark, tmp_path):
    texts, target = tmp_path / "texts", str(tmp_path / "target")
    put(texts, "a.csv", GOOD.format(1), GOOD.format(2))
    assert len(csv_files.ingest_new(spark, str(texts), "dim_products", target)) == 1
    assert csv_files.ingest_new(spark, str(texts), "dim_products", target) == []
    put(texts, "b.csv", GOOD.format(3), "4,short")
    put(texts, "_hidden.csv", GOOD.format(9))
    (path,) = csv_files.ingest_new(spark, str(texts), "dim_products", target)
    assert path.endswith("b.csv")
    assert keys(spark, target) == [(1, 1), (2, 1), (3, 2)]
    assert csv_files.loaded_files(spark, target).count() == 2


def test_a_changed_file_stops_the_load(spark, tmp_path):
    texts, target = tmp_path / "texts", str(tmp_path / "target")
    put(texts, "a.csv", GOOD.format(1))
    csv_files.ingest_new(spark, str(texts), "dim_products", target)
    put(texts, "a.csv", GOOD.format(1), GOOD.format(2))
    put(texts, "b.csv", GOOD.format(3))
    with pytest.raises(ValueError, match="a.csv has changed"):
        csv_files.ingest_new(spark, str(texts), "dim_products", target)
    assert keys(spark, target) == [(1, 1)]


def test_too_many_rejected_rows_stop_a_load(spark, tmp_path):
    texts, target = tmp_path / "texts", str(tmp_path / "target")
    put(texts, "a.csv", GOOD.format(1), GOOD.format(2), GOOD.format(3), "4,short")
    csv_files.ingest_new(spark, str(texts), "dim_products", target, most_rejected=0.25)
    put(texts, "b.csv", GOOD.format(5), "6,short", "7,short")
    with pytest.raises(ValueError, match="2 of 3 rows are rejected"):
        csv_files.ingest_new(spark, str(texts), "dim_products", target, most_rejected=0.25)
    assert keys(spark, target) == [(1, 1), (2, 1), (3, 1)]
    # The file can be mended and loaded, since it has not been loaded yet.
    put(texts, "b.csv", GOOD.format(5))
    assert len(csv_files.ingest_new(spark, str(texts), "dim_products", target, most_rejected=0.25)) == 1

    whole = str(tmp_path / "whole")
    csv_files.ingest(spark, str(texts / "b.csv"), "dim_products", whole, most_rejected=0.0)
    with pytest.raises(ValueError, match="1 of 4 rows are rejected"):
        csv_files.ingest(spark, str(texts / "a.csv"), "dim_products", whole, most_rejected=0.1)
    assert [r.product_key for r in csv_files.accepted(spark, "dim_products", whole).collect()] == [5]
    assert len(versions.history(spark, whole)) == 1


def test_new_sales_go_on_to_what_is_carried(spark, tmp_path):
    texts, target, root = (str(tmp_path / n) for n in ("texts", "target", "root"))
    for i, day in enumerate(["2013-05-01", "2013-06-01"]):
        rows = star(spark, sales=[sale(f"{i}", day=day), sale(f"{i}x", day=day, amount=5)]).sales
        csv_files.export_csv(rows, "fact_sales", os.path.join(texts, str(i)))
        csv_files.ingest_new(spark, texts, "fact_sales", target)
        new = csv_files.added(spark, "fact_sales", target).where(f"load = {i + 1}")
        balances.add_load(spark, root, new.select(*SALES.names))
    spent = {r.order_number: r.cumulative_spend for r in balances.customer_spend(spark, root).collect()}
    assert spent == {"0": 10, "0x": 15, "1": 25, "1x": 30}
