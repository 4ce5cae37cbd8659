"""The three tables of the star schema and the rules declared on them.

Keys are ``bigint`` so that very large stores fit; sums of integers widen to
``bigint`` for the same reason. Everything is nullable on load: the required
columns and unique keys below are audited (``operators.quality``), not assumed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

TEXT_LIMIT = 50
QUANTITY_RANGE = (0, 255)


def _table(**columns) -> StructType:
    return StructType([StructField(name, dtype(), True) for name, dtype in columns.items()])


CUSTOMERS = _table(
    customer_key=LongType,
    customer_id=LongType,
    customer_number=StringType,
    first_name=StringType,
    last_name=StringType,
    country=StringType,
    marital_status=StringType,
    gender=StringType,
    birthdate=DateType,
    create_date=DateType,
)

PRODUCTS = _table(
    product_key=LongType,
    product_id=LongType,
    product_number=StringType,
    product_name=StringType,
    category_id=StringType,
    category=StringType,
    subcategory=StringType,
    maintenance=StringType,
    cost=IntegerType,
    product_line=StringType,
    start_date=DateType,
)

SALES = _table(
    order_number=StringType,
    product_key=LongType,
    customer_key=LongType,
    order_date=DateType,
    shipping_date=DateType,
    due_date=DateType,
    sales_amount=IntegerType,
    quantity=ShortType,
    price=IntegerType,
)

# Physical column added when sales are published: the folder they are kept in.
YEAR_COLUMN = "order_year"
YEAR_FIELD = StructField(YEAR_COLUMN, IntegerType(), True)

TABLES = {"dim_customers": CUSTOMERS, "dim_products": PRODUCTS, "fact_sales": SALES}

REQUIRED = {
    "dim_customers": ["customer_key", "customer_id"],
    "dim_products": ["product_key", "product_id"],
    "fact_sales": ["order_number", "product_key", "customer_key"],
}

UNIQUE = {
    "dim_customers": ["customer_key"],
    "dim_products": ["product_key"],
    "fact_sales": ["order_number", "product_key"],
}


@dataclass(frozen=True)
class Star:
    """The inputs of every operator."""

    sales: DataFrame
    customers: DataFrame
    products: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "dim_customers": self.customers,
            "dim_products": self.products,
            "fact_sales": self.sales,
        }

    def collated(self, name: str = "UTF8_LCASE_RTRIM") -> Star:
        """The star with texts compared under a collation.

        Texts are compared byte by byte by default. A store whose texts differ
        in case or trailing blanks only can be read as if they were equal.
        """

        def compared(rows: DataFrame) -> DataFrame:
            return rows.withColumns(
                {
                    f.name: F.collate(f.name, name)
                    for f in rows.schema.fields
                    if isinstance(f.dataType, StringType)
                }
            )

        return Star(compared(self.sales), compared(self.customers), compared(self.products))
