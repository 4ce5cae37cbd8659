"""Table facts and audits of the declared keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from starmart.config import Config
from starmart.schema import REQUIRED, TABLES, TEXT_LIMIT, UNIQUE, Star


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def list_tables(spark: SparkSession, database: str | None = None) -> list[tuple]:
    """Catalog, schema, name and type of the tables the session knows."""
    return [
        (t.catalog, ".".join(t.namespace or []), t.name, t.tableType)
        for t in spark.catalog.listTables(database)
    ]


def table_catalog(star: Star, config: Config) -> DataFrame:
    """The tables of the star, where the session looks them up, and their rows."""
    return _stacked(
        [
            rows.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.current_catalog().alias("table_catalog"),
                F.current_schema().alias("table_schema"),
                F.lit(name).alias("table_name"),
                F.lit("BASE TABLE").alias("table_type"),
                "row_count",
            )
            for name, rows in star.tables().items()
        ]
    )


def column_profile(star: Star, config: Config) -> DataFrame:
    """Type, as the table has it, and content of every column; one pass per table.

    The declared type and length stand beside what the table says.
    """
    parts = []
    for name, rows in star.tables().items():
        fields = [(f, rows.schema[f.name]) for f in TABLES[name].fields]
        measures = []
        for _, f in fields:
            column = F.col(f.name)
            measures.append(F.count_if(column.isNull()).alias(f"{f.name}_nulls"))
            if isinstance(f.dataType, StringType):
                measures.append(F.max(F.length(column)).alias(f"{f.name}_longest"))
        lines = [
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(declared.dataType.simpleString()).alias("declared_type"),
                F.lit("YES" if f.nullable else "NO").alias("is_nullable"),
                F.lit(TEXT_LIMIT if isinstance(declared.dataType, StringType) else None)
                .cast("int")
                .alias("character_maximum_length"),
                F.col(f"{f.name}_nulls").alias("null_values"),
                (
                    F.col(f"{f.name}_longest")
                    if isinstance(f.dataType, StringType)
                    else F.lit(None).cast("int")
                ).alias("longest_value"),
            )
            for declared, f in fields
        ]
        parts.append(
            rows.agg(*measures).select(
                F.lit(name).alias("table_name"), F.inline(F.array(*lines))
            )
        )
    return _stacked(parts)


def required_values(star: Star, config: Config) -> DataFrame:
    """Missing values in the columns that must not be empty."""
    parts = []
    for name, rows in star.tables().items():
        counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in REQUIRED[name]])
        lines = [
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations"))
            for c in REQUIRED[name]
        ]
        parts.append(
            counts.select(F.lit(name).alias("table_name"), F.inline(F.array(*lines)))
        )
    return _stacked(parts)


def repeated_keys(star: Star, config: Config) -> DataFrame:
    """Keys that occur more than once. For sales this is a report, not a rule."""
    parts = []
    for name, rows in star.tables().items():
        text = F.to_json(F.struct(*UNIQUE[name]))
        parts.append(
            rows.groupBy(*UNIQUE[name])
            .agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1)
            .select(F.lit(name).alias("table_name"), text.alias("key_value"), "copies")
        )
    return _stacked(parts)


def long_texts(star: Star, config: Config) -> DataFrame:
    """Values longer than the declared limit, per text column. They are kept whole."""
    parts = []
    for name, rows in star.tables().items():
        texts = [f.name for f in TABLES[name].fields if isinstance(f.dataType, StringType)]
        counts = rows.agg(*[F.count_if(F.length(c) > TEXT_LIMIT).alias(c) for c in texts])
        lines = [
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in texts
        ]
        parts.append(counts.select(F.lit(name).alias("table_name"), F.inline(F.array(*lines))))
    return _stacked(parts)


def rule_violations(star: Star, config: Config) -> DataFrame:
    """Violations per rule: required columns, dimension keys and text lengths.

    Lengths are audited only (``enforced`` is false); the others stop a load.
    """
    longer = long_texts(star, config).select(
        "table_name",
        F.concat(F.lit("length "), "column_name").alias("rule"),
        "violations",
        F.lit(False).alias("enforced"),
    )
    required = required_values(star, config).select(
        "table_name", F.concat(F.lit("required "), "column_name").alias("rule"), "violations"
    )
    keys = [
        star.tables()[name]
        .groupBy(*UNIQUE[name])
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(F.count_if(F.col("copies") > 1).alias("violations"))
        .select(
            F.lit(name).alias("table_name"),
            F.lit("unique " + ", ".join(UNIQUE[name])).alias("rule"),
            "violations",
        )
        for name in ("dim_customers", "dim_products")
    ]
    enforced = _stacked([required, *keys]).withColumn("enforced", F.lit(True))
    return enforced.unionByName(longer)


def enforce(star: Star, config: Config) -> Star:
    """The star, if it keeps every rule; otherwise an error that names the broken ones."""
    # One row per rule.
    broken = rule_violations(star, config).where("enforced and violations > 0").collect()
    if broken:
        listed = "; ".join(f"{r.table_name}: {r.rule} ({r.violations})" for r in broken)
        raise ValueError(f"broken rules: {listed}")
    return star


def unknown_references(star: Star, config: Config) -> DataFrame:
    """Keys used by sales that their dimension does not hold, with their rows.

    Sales are counted per key before the join, so a frequent key is one row.
    """
    parts = []
    for key, dimension in (
        ("customer_key", star.customers),
        ("product_key", star.products),
    ):
        used = (
            star.sales.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("sales_rows"))
        )
        parts.append(
            used.join(dimension.select(key), key, "left_anti").select(
                F.lit(key).alias("key_column"), F.col(key).alias("key_value"), "sales_rows"
            )
        )
    return _stacked(parts)
