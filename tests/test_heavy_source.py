"""Heavy keys are sought in stored rows, not in rows that are computed again for it."""

import pytest

from starmart.carried import reports
from starmart.config import Config
from starmart.operators import heavy
from starmart.registry import OPERATORS

from .rows import customer, product, sale, star

CONFIG = Config()


def small(spark):
    return star(
        spark,
        sales=[sale("1"), sale("2"), sale("2", customer=None), sale("3", product=None)],
        customers=[customer(1)],
        products=[product(1)],
    )


def weighed(monkeypatch) -> list[str]:
    """Plans of the rows in which heavy keys are sought; every dimension counts as large."""
    found, plain = [], heavy.heavy_keys

    def noted(rows, key, *more):
        found.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return plain(rows, key, *more)

    monkeypatch.setattr(heavy, "heavy_keys", noted)
    monkeypatch.setattr(heavy, "is_large", lambda dimension: True)
    return found


@pytest.mark.parametrize("name", ["customer_behavior", "bottom3_customers_orders"])
def test_heavy_keys_are_sought_in_rows_as_they_are(spark, monkeypatch, name):
    plans = weighed(monkeypatch)
    OPERATORS[name](small(spark), CONFIG)
    assert plans and not any("Aggregate" in text for text in plans)


def test_carried_heavy_keys_are_sought_in_stored_cells(spark, monkeypatch, tmp_path):
    s, root = small(spark), str(tmp_path / "reports")
    reports.add_load(spark, root, s.sales, CONFIG)
    plans = weighed(monkeypatch)
    reports.customer_report(spark, root, s, CONFIG)
    assert plans and not any("Aggregate" in text for text in plans)


def test_single_keys_are_counted_in_heavy_groups_only(spark):
    rows = spark.range(20_000).selectExpr("if(id % 4 = 0, 7, id) as k")
    found = heavy.heavy_keys(rows, "k")
    assert [r.k for r in found.collect()] == [7]
    assert "_hash" in found._jdf.queryExecution().optimizedPlan().toString()
