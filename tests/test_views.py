from __future__ import annotations

from starmart.config import Config
from starmart.operators import quality
from starmart.plans import views
from tests.rows import customer, product, sale, star


def test_views_answer_sql(spark):
    s = star(spark, sales=[sale("1")], customers=[customer(1)], products=[product(1), product(2)])
    named = views.register(s, Config())
    assert set(named) <= {t[2] for t in quality.list_tables(spark)}
    assert spark.sql("select count(*) from v_product_performance_report").first()[0] == 2
    row = spark.sql("select customer_name, sales_2013 from v_customer_behavior_report").first()
    assert tuple(row) == ("Ann Lee", 10)
    total = spark.sql(
        "select sum(sales_amount) from fact_sales join dim_customers using (customer_key)"
    )
    assert total.first()[0] == 10


def test_stored_reports_are_replaced(spark, tmp_path):
    root = str(tmp_path / "reports")
    for sales in ([sale("1")], [sale("1"), sale("2", customer=2)]):
        s = star(spark, sales=sales, customers=[customer(1), customer(2)], products=[product(1)])
        views.materialise(s, Config(), root)
    assert views.stored(spark, root)["v_customer_behavior_report"].count() == 2
