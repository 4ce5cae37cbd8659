from __future__ import annotations

from datetime import date

import pytest

from starmart import __main__ as program
from starmart.plans import views
from starmart.registry import OPERATORS
from starmart.sources import csv_files
from tests.rows import customer, product, sale, star


@pytest.fixture
def texts(spark, tmp_path):
    s = star(
        spark,
        sales=[sale("1"), sale("2", day="2014-01-02", amount=7)],
        customers=[customer(1)],
        products=[product(1), product(2)],
    )
    for name, rows in s.tables().items():
        csv_files.export_csv(rows, name, str(tmp_path / "texts" / f"{name}.csv"))
    return str(tmp_path / "texts")


def test_load_run_and_store(spark, texts, tmp_path, capsys):
    root, target = str(tmp_path / "root"), str(tmp_path / "out")
    program.main(["load", texts, root])
    program.main(["run", "measure_total_sales", root])
    assert "17" in capsys.readouterr().out
    program.main(["run", "rank_customers_in_year", root, "--set", "ranking_year=2013",
                  "--to", target])
    assert [r.total_revenue for r in spark.read.parquet(target).collect()] == [10]
    program.main(["reports", root, target, "--set", "report_anchor=2014-02-01"])
    stored = views.stored(spark, target)["v_product_performance_report"]
    assert {r.product_key: r.recency_in_months for r in stored.collect()} == {1: 1, 2: None}


def test_settings_take_the_type_of_their_default():
    config = program._config(["age_anchor=2000-12-31", "vip_spend=9", "margin_high_above=0.5"])
    assert (config.age_anchor, config.vip_spend) == (date(2000, 12, 31), 9)
    assert config.margin_high_above == 0.5
    with pytest.raises(SystemExit):
        program._config(["colour=red"])


def test_broken_rules_stop_the_load(spark, tmp_path):
    s = star(spark, customers=[customer(1), customer(1)])
    for name, rows in s.tables().items():
        csv_files.export_csv(rows, name, str(tmp_path / f"{name}.csv"))
    with pytest.raises(ValueError, match="unique customer_key"):
        program.main(["load", str(tmp_path), str(tmp_path / "root")])


def test_a_refused_load_leaves_the_store(spark, texts, tmp_path, capsys):
    root, bad = str(tmp_path / "root"), tmp_path / "bad"
    program.main(["load", texts, root])
    s = star(spark, customers=[customer(1), customer(1)], sales=[sale("9", amount=99)])
    for name, rows in s.tables().items():
        csv_files.export_csv(rows, name, str(bad / f"{name}.csv"))
    with pytest.raises(ValueError, match="unique customer_key"):
        program.main(["load", str(bad), root])
    program.main(["run", "measure_total_sales", root])
    assert "17" in capsys.readouterr().out


def test_rows_to_show(spark, texts, tmp_path, capsys):
    root = str(tmp_path / "root")
    program.main(["load", texts, root])
    program.main(["run", "dq_required", root, "--rows", "1"])
    assert "only showing top 1 row" in capsys.readouterr().out


def test_names_are_listed(capsys):
    program.main(["list"])
    assert capsys.readouterr().out.split() == list(OPERATORS)
