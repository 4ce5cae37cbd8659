"""A product catalogue file, loaded and summed up."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.registry import OPERATORS
from starmart.schema import PRODUCTS, Star
from starmart.sources import csv_files
from tests.rows import listed, star

CONFIG = Config()
LINES = [
    ",".join(PRODUCTS.names),
    "1,501,AA-1,Tall Vase,HO_VA,Home,Vases,No,40,House,01/07/2003",
    "2,502,AA-2,Low Vase,HO_VA,Home,Vases,No,99,House,1/7/2003",
    "3,503,AA-3,Oak Chair,HO_CH,Home,Chairs,Yes,100,House,28/12/2011",
    "4,504,AB-1,Steel Desk,OF_DE,Office,Desks,Yes,500,Work,31/12/2012",
    "5,505,AB-2,Glass Desk,OF_DE,Office,Desks,Yes,1000,Work,01/07/2013",
    "6,506,AB-3,Board Table,OF_TA,Office,Tables,Yes,1001,Work,01/07/2013",
    "7,507,AC-1,Loose Part,ZZ_PA,,,,0,,01/07/2013",
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("catalog")
    (folder / "dim_products.csv").write_text("\n".join(LINES) + "\n")
    target = str(folder / "dim_products")
    products = csv_files.ingest(
        spark, str(folder / "dim_products.csv"), "dim_products", target
    )
    assert csv_files.rejected(spark, "dim_products", target).isEmpty()
    empty = star(spark)
    return Star(empty.sales, empty.customers, products)


def test_contents(store):
    facts = store.products.agg(
        F.count("*"),
        F.count_distinct("product_key"),
        F.count_if(F.col("category").isNull()),
        F.sum("cost"),
        F.count_if(F.col("cost") == 0),
    )
    assert listed(facts) == [(7, 7, 1, 2740, 1)]


def test_starts(store):
    assert listed(OPERATORS["range_product_start"](store, CONFIG)) == [
        (date(2003, 7, 1), date(2013, 7, 1), 120)
    ]
    starts = store.products.groupBy(F.year("start_date")).count()
    assert dict(listed(starts)) == {2003: 2, 2011: 1, 2012: 1, 2013: 3}


def test_groups(store):
    assert listed(OPERATORS["mag_avg_cost_by_category"](store, CONFIG)) == [
        ("Office", 833),
        ("Home", 79),
        (None, 0),
    ]
    assert dict(listed(OPERATORS["segment_cost_range"](store, CONFIG))) == {
        "Below 100": 3,
        "100-500": 2,
        "500-1000": 1,
        "Above 1000": 1,
    }
    assert OPERATORS["mag_products_by_subcategory"](store, CONFIG).count() == 5
    assert OPERATORS["explore_catalog"](store, CONFIG).count() == 7
    assert OPERATORS["mag_never_sold"](store, CONFIG).count() == 7
