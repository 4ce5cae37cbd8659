"""Small stars from a few hand-written rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from starmart.schema import CUSTOMERS, PRODUCTS, SALES, Star


def _table(spark: SparkSession, schema, rows: list[dict]) -> DataFrame:
    values = [tuple(row.get(name) for name in schema.names) for row in rows]
    return spark.createDataFrame(values, schema)


def star(spark, sales=(), customers=(), products=()) -> Star:
    return Star(
        _table(spark, SALES, list(sales)),
        _table(spark, CUSTOMERS, list(customers)),
        _table(spark, PRODUCTS, list(products)),
    )


def sale(order, product=1, customer=1, day="2013-06-15", amount=10, quantity=1, price=10):
    return {
        "order_number": order,
        "product_key": product,
        "customer_key": customer,
        "order_date": day and date.fromisoformat(day),
        "sales_amount": amount,
        "quantity": quantity,
        "price": price,
    }


def product(key, name="thing", category="Bikes", subcategory="Road", cost=5, **more):
    return {
        "product_key": key,
        "product_id": key,
        "product_name": name,
        "category": category,
        "subcategory": subcategory,
        "cost": cost,
        **more,
    }


def customer(key, first="Ann", last="Lee", country="Peru", **more):
    return {
        "customer_key": key,
        "customer_id": key,
        "customer_number": f"C{key}",
        "first_name": first,
        "last_name": last,
        "country": country,
        **more,
    }


def listed(rows: DataFrame) -> list[tuple]:
    return [tuple(row) for row in rows.collect()]
