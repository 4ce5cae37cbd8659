from __future__ import annotations

import shutil
from datetime import date

import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from starmart.config import Config
from starmart.operators import quality
from starmart.plans.customer_behavior import customer_behavior
from starmart.schema import PRODUCTS, SALES, TABLES, Star
from starmart.sources import csv_files, storage, tpch
from tests.conftest import DATA
from tests.rows import customer, listed, product, sale, star

CONFIG = Config()
HEADER = ",".join(PRODUCTS.names)


@pytest.fixture
def catalog_file(tmp_path):
    lines = [
        HEADER,
        "1,210,FR-1,Frame 58,CO_RF,Components,Road Frames,Yes,0,Road,01/07/2003",
        "2,211,PE-1,Pedal,CO_PE,,,,28,Mountain,31/12/2013",
        '3,212,CA-1,"Cap, blue",AC_CA,Accessories,Caps,No,9,Other Sales,02/01/2012',
        "4,213,short row",
        "5,214,BK-1,Bike,BI_RB,Bikes,Road Bikes,Yes,12,Road,01/07/2011,extra",
        "6,215,BK-2,Bike,BI_RB,Bikes,Road Bikes,Yes,many,Road,01/07/2011",
        "7,216,BK-3,Bike,BI_RB,Bikes,Road Bikes,Yes,12,Road,2011-31-31",
    ]
    path = tmp_path / "products.csv"
    path.write_bytes("\r\n".join(lines).encode() + b"\r\n")
    return str(path)


def test_day_first_file_with_bad_rows(spark, catalog_file, tmp_path):
    target = str(tmp_path / "dim_products")
    for _ in range(2):  # a second load replaces the first
        rows = csv_files.ingest(spark, catalog_file, "dim_products", target)
    loaded = {r.product_key: r for r in rows.collect()}
    assert set(loaded) == {1, 2, 3}
    assert loaded[1].start_date == date(2003, 7, 1)
    assert loaded[2].start_date == date(2013, 12, 31)
    assert (loaded[2].category, loaded[2].subcategory, loaded[2].maintenance) == (None,) * 3
    assert loaded[3].product_name == "Cap, blue"
    assert rows.schema.names == PRODUCTS.names

    bad = csv_files.rejected(spark, "dim_products", target).collect()
    assert sorted(r._raw_line.strip()[:2] for r in bad) == ["4,", "5,", "6,", "7,"]


def test_file_without_rows(spark, tmp_path):
    path = tmp_path / "empty.csv"
    for table in ("dim_products", "fact_sales"):
        path.write_text(",".join(TABLES[table].names) + "\n")
        rows = csv_files.ingest(spark, str(path), table, str(tmp_path / table))
        assert rows.isEmpty() and csv_files.rejected(spark, table, str(tmp_path / table)).isEmpty()


def test_quantity_must_fit_the_declared_range(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(
        ",".join(SALES.names)
        + "\nSO1,1,1,05/03/2013,06/03/2013,07/03/2013,10,255,10"
        + "\nSO2,1,1,,06/03/2013,07/03/2013,10,,10"
        + "\nSO3,1,1,05/03/2013,06/03/2013,07/03/2013,10,256,10"
        + "\nSO4,1,1,05/03/2013,06/03/2013,07/03/2013,10,-1,10\n"
    )
    target = str(tmp_path / "fact_sales")
    rows = csv_files.ingest(spark, str(path), "fact_sales", target).collect()
    assert sorted((r.order_number, r.order_year) for r in rows) == [("SO1", 2013), ("SO2", None)]
    bad = csv_files.rejected(spark, "fact_sales", target).collect()
    assert sorted(r.order_number for r in bad) == ["SO3", "SO4"]


def test_reload_replaces_years_that_are_gone(spark, tmp_path):
    target = str(tmp_path / "fact_sales")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for day in ("2012-05-01", "2013-05-01"):
            storage.write_sales(star(spark, sales=[sale("1", day=day)]).sales, target)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert [r.order_year for r in storage.read_sales(spark, target).collect()] == [2013]


def test_text_round_trip_keeps_every_value(spark, tmp_path):
    rows = star(
        spark, customers=[customer(1, first=" padded ", last='say "x", y'), customer(2, first=None)]
    ).customers
    text, target = str(tmp_path / "text"), str(tmp_path / "table")
    csv_files.export_csv(rows, "dim_customers", text)
    again = csv_files.ingest(spark, text, "dim_customers", target)
    assert sorted(listed(again), key=repr) == sorted(listed(rows), key=repr)


def test_published_star_holds_every_row(spark):
    folder = f"{DATA}/sf0.001"
    derived, stored = tpch.derive(spark, folder), tpch.star(spark, folder)
    for name, rows in derived.tables().items():
        again = stored.tables()[name].select(*rows.columns)
        assert again.dtypes == rows.dtypes
        assert again.exceptAll(rows).isEmpty() and rows.exceptAll(again).isEmpty()
    assert derived.sales.count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_shared_folder_is_the_configured_one(spark):
    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


class _Cluster:
    """A session stand-in without the setting, away from local mode."""

    class _Conf:
        @staticmethod
        def get(name, default=None):
            return default

    class _Context:
        master = "spark://somewhere"
        applicationId = "app"

        @staticmethod
        def getConf():
            return _Cluster._Conf

        @staticmethod
        def getCheckpointDir():
            return None

    conf = _Conf
    sparkContext = _Context


def test_changed_tables_are_published_anew(spark, tmp_path):
    for name in ("customer", "nation", "part", "orders", "lineitem"):
        shutil.copyfile(f"{DATA}/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    before = tpch.star(spark, str(tmp_path)).products.count()
    assert len([key for key in tpch._published if key[1] == str(tmp_path)]) == 1
    fewer = pyarrow.parquet.read_table(tmp_path / "part.parquet").slice(0, 50)
    pyarrow.parquet.write_table(fewer, tmp_path / "part.parquet")
    assert before > 50 == tpch.star(spark, str(tmp_path)).products.count()


def test_star_without_shared_folder_is_not_written(spark, monkeypatch):
    monkeypatch.setattr(tpch, "has_shared_folder", lambda session: False)
    monkeypatch.setattr(tpch, "publish", None)
    assert tpch.star(spark, f"{DATA}/sf0.001").sales.columns == SALES.names


def test_cluster_without_shared_folder_is_refused():
    assert not storage.has_shared_folder(_Cluster)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(_Cluster)


def _defective(spark) -> Star:
    return star(
        spark,
        sales=[sale("1"), sale("1"), sale(None, product=9, customer=8), sale("2", customer=None)],
        customers=[customer(1), customer(1), customer(2, customer_id=None)],
        products=[product(1), product(2, name="longer name")],
    )


def test_audits_find_planted_defects(spark):
    s = _defective(spark)
    required = {(r.table_name, r.column_name): r.violations
                for r in quality.required_values(s, CONFIG).collect()}
    assert {k: v for k, v in required.items() if v} == {
        ("dim_customers", "customer_id"): 1,
        ("fact_sales", "order_number"): 1,
        ("fact_sales", "customer_key"): 1,
    }
    assert len(required) == 7
    assert sorted(listed(quality.repeated_keys(s, CONFIG))) == [
        ("dim_customers", '{"customer_key":1}', 2),
        ("fact_sales", '{"order_number":"1","product_key":1}', 2),
    ]
    assert sorted(listed(quality.unknown_references(s, CONFIG))) == [
        ("customer_key", 8, 1),
        ("product_key", 9, 1),
    ]


def test_rules_are_enforced(spark):
    with pytest.raises(ValueError) as error:
        quality.enforce(_defective(spark), CONFIG)
    for rule in (
        "dim_customers: required customer_id (1)",
        "dim_customers: unique customer_key (1)",
        "fact_sales: required order_number (1)",
        "fact_sales: required customer_key (1)",
    ):
        assert rule in str(error.value)
    # A product twice on one order is reported, not refused.
    sound = star(
        spark, sales=[sale("1"), sale("1")], customers=[customer(1)], products=[product(1)]
    )
    assert quality.enforce(sound, CONFIG) is sound


def test_profile_and_catalog(spark):
    s = _defective(spark)
    profile = {(r.table_name, r.column_name): r for r in
               quality.column_profile(s, CONFIG).collect()}
    assert len(profile) == 30
    name = profile["dim_products", "product_name"]
    assert (name.data_type, name.character_maximum_length, name.longest_value) == ("string", 50, 11)
    assert profile["fact_sales", "customer_key"].null_values == 1
    counts = {r.table_name: r.row_count for r in quality.table_catalog(s, CONFIG).collect()}
    assert counts == {"dim_customers": 3, "dim_products": 2, "fact_sales": 4}


def test_profile_shows_what_the_table_has(spark):
    s = _defective(spark)
    wrong = Star(s.sales.withColumn("price", F.col("price").cast("string")), s.customers, s.products)
    profile = {r.column_name: r for r in quality.column_profile(wrong, CONFIG).collect()}
    assert (profile["price"].data_type, profile["price"].declared_type) == ("string", "int")
    assert profile["price"].longest_value is not None
    assert (profile["quantity"].data_type, profile["quantity"].declared_type) == ("smallint",) * 2


def test_key_texts_are_unambiguous(spark):
    s = star(spark, sales=[sale("1|1"), sale("1|1"), sale(None), sale(None), sale(""), sale("")])
    values = [r.key_value for r in quality.repeated_keys(s, CONFIG).collect()]
    assert len(values) == len(set(values)) == 3


@pytest.mark.parametrize("text", ["1/2/2010", "01/02/2010", "1/02/2010"])
def test_days_come_first_with_or_without_zeros(spark, tmp_path, text):
    path, target = str(tmp_path / "t.csv"), str(tmp_path / "t")
    (tmp_path / "t.csv").write_text(
        "order_number,product_key,customer_key,order_date,shipping_date,due_date,sales_amount,"
        f"quantity,price\nSO1,1,1,{text},{text},,10,1,10\nSO2,1,1,31/02/2010,,,10,1,10\n"
        "SO3,1,1,13/13/2010,,,10,1,10\n"
    )
    good = csv_files.ingest(spark, path, "fact_sales", target).collect()
    assert [(r.order_number, r.order_date.isoformat()) for r in good] == [("SO1", "2010-02-01")]
    assert csv_files.rejected(spark, "fact_sales", target).count() == 2


def test_long_texts_are_kept_and_reported(spark):
    s = star(spark, products=[product(1, name="x" * 50), product(2, name="x" * 51)])
    rules = {(r.table_name, r.rule): r for r in quality.rule_violations(s, CONFIG).collect()}
    found = rules["dim_products", "length product_name"]
    assert (found.violations, found.enforced) == (1, False)
    assert quality.enforce(s, CONFIG) is s


def test_a_line_without_an_order_stays(spark, tmp_path):
    for name in ("customer", "nation", "part", "lineitem"):
        shutil.copyfile(f"{DATA}/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    orders = pyarrow.parquet.read_table(f"{DATA}/sf0.001/orders.parquet")
    pyarrow.parquet.write_table(orders.slice(0, 10), tmp_path / "orders.parquet")
    lines = spark.read.parquet(str(tmp_path / "lineitem.parquet")).count()
    assert tpch.sales(spark, str(tmp_path)).count() == lines


def test_session_catalog_lists_tables(spark):
    _defective(spark).customers.createOrReplaceTempView("dim_customers_listed")
    assert "dim_customers_listed" in {t[2] for t in quality.list_tables(spark)}


def test_files_to_report(spark, tmp_path):
    """Text files, loaded tables, report: the same as from the published star."""
    published = tpch.star(spark, f"{DATA}/sf0.001")
    loaded = {}
    for name, rows in published.tables().items():
        csv_files.export_csv(rows, name, str(tmp_path / "text" / name))
        csv_files.ingest(spark, str(tmp_path / "text" / name), name, str(tmp_path / name))
        loaded[name] = csv_files.accepted(spark, name, str(tmp_path / name))
        assert csv_files.rejected(spark, name, str(tmp_path / name)).isEmpty()
    again = Star(loaded["fact_sales"], loaded["dim_customers"], loaded["dim_products"])
    expected = customer_behavior(published, tpch.TPCH_CONFIG)
    actual = customer_behavior(again, tpch.TPCH_CONFIG)
    assert sorted(listed(actual), key=repr) == sorted(listed(expected), key=repr)
