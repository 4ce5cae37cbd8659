"""Operators against DuckDB on small random stars with NULLs everywhere.

The generated test tables never miss an amount, a quantity or an order number;
these stars do. Partition coalescing is off, so results come from many tasks.
"""

from __future__ import annotations

import random
from datetime import date, timedelta

import duckdb
import pytest

from starmart.checks import oracle_sql
from starmart.registry import OPERATORS
from starmart.schema import TABLES
from starmart.sources.tpch import TPCH_CONFIG
from tests.rows import star
from tests.test_oracle import _sorted

SQL_TYPES = {
    "bigint": "bigint",
    "int": "integer",
    "smallint": "smallint",
    "string": "varchar",
    "date": "date",
}


def _rows(seed):
    draw = random.Random(seed)

    def maybe(value, chance=0.12):
        return None if draw.random() < chance else value

    def day(first, days):
        return first + timedelta(days=draw.randrange(days))

    customers = [
        {
            "customer_key": key,
            "customer_id": maybe(key + 100),
            "customer_number": f"C{key}",
            "first_name": maybe(draw.choice(["Ann", "Bo"])),
            "last_name": maybe(draw.choice(["Lee", "Ray"])),
            "country": maybe(draw.choice(["Peru", "Chad"])),
            "gender": maybe(draw.choice(["Male", "Female"])),
            "birthdate": maybe(day(date(1945, 1, 1), 15000)),
        }
        for key in range(25)
    ]
    products = [
        {
            "product_key": key,
            "product_id": maybe(key + 100),
            "product_name": maybe(draw.choice(["bolt", "gear", "ring", "rod"])),
            "category": maybe(draw.choice(["A", "B", "C"])),
            "subcategory": maybe(draw.choice(["x", "y"])),
            "product_line": maybe("Road"),
            "cost": maybe(draw.choice([0, 1, 50, 99, 100, 500, 1000, 2000])),
            "start_date": maybe(day(date(1993, 1, 1), 900)),
        }
        for key in range(20)
    ]
    sales = []
    for _ in range(400):
        # A third of the sales belongs to one customer and one product.
        hot = draw.random() < 0.33
        buyer = maybe(4 if hot else draw.randrange(32))
        # Some customers never have an amount, some never an order number.
        no_amount = 1.0 if buyer in (20, 21, 22) else 0.12
        no_number = 1.0 if buyer in (17, 18, 19) else 0.12
        # Some start late, so that every kind of newcomer occurs.
        start = date(2000, 9, 20) if buyer in (10, 11, 20, 23) else date(1998, 6, 1)
        span = 150 if start.year == 2000 else 1100
        sales.append(
            {
                "order_number": maybe(f"SO{draw.randrange(150)}", no_number),
                "product_key": maybe(3 if hot else draw.randrange(26)),
                "customer_key": buyer,
                "order_date": maybe(day(start, span)),
                "sales_amount": maybe(draw.choice([0, 1, 5, 300, 2500, 9000]), no_amount),
                "quantity": maybe(draw.choice([0, 1, 2, 7])),
                "price": maybe(draw.choice([0, 1, 2, 5])),
            }
        )
    return {"dim_customers": customers, "dim_products": products, "fact_sales": sales}


@pytest.fixture(scope="module", params=range(4))
def both(request, spark):
    rows = _rows(request.param)
    duck = duckdb.connect()
    for name, schema in TABLES.items():
        kinds = ", ".join(
            f"{f.name} {SQL_TYPES[f.dataType.simpleString()]}" for f in schema.fields
        )
        duck.execute(f"create table {name} ({kinds})")
        duck.executemany(
            f"insert into {name} values ({', '.join('?' * len(schema.names))})",
            [[row.get(column) for column in schema.names] for row in rows[name]],
        )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield star(spark, rows["fact_sales"], rows["dim_customers"], rows["dim_products"]), duck
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    duck.close()


def _on_tables(sql: str) -> str:
    """The statement without the block that rebuilds the star."""
    block = f"with {oracle_sql._STAR}"
    for prefix, rest in ((f"{block}, ", "with "), (f"{block} ", "")):
        if sql.startswith(prefix):
            return rest + sql.removeprefix(prefix)
    raise AssertionError("statement does not begin with the star")


STATEMENTS = {name: _on_tables(sql) for name, sql in oracle_sql.statements().items()}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_matches_sql(both, name):
    tables, duck = both
    ours = OPERATORS[name](tables, TPCH_CONFIG)
    theirs = duck.execute(STATEMENTS[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    names = sorted(columns)
    expected = _sorted(theirs.fetchall(), [columns.index(n) for n in names])
    actual = _sorted(ours.collect(), [ours.columns.index(n) for n in names])
    assert actual == expected
