"""Loads a store and runs its queries: ``python -m starmart --help``.

Also works as the main file of ``spark-submit``.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import fields
from datetime import date

from pyspark.sql import SparkSession

from starmart.config import Config
from starmart.operators import quality
from starmart.plans import views
from starmart.registry import OPERATORS
from starmart.schema import TABLES, Star
from starmart.sources import csv_files, versions


def _config(settings: Sequence[str]) -> Config:
    """Settings as ``name=value``, with the type of the default."""
    defaults = {f.name: f.default for f in fields(Config)}
    values = {}
    for setting in settings:
        name, _, text = setting.partition("=")
        if name not in defaults:
            raise SystemExit(f"unknown setting: {name}")
        kind = type(defaults[name])
        values[name] = date.fromisoformat(text) if kind is date else kind(text)
    return Config(**values)


def load(spark: SparkSession, texts: str, root: str) -> None:
    """``texts``/<table>.csv into typed tables below ``root``, all three at once.

    The new tables count once the rules have been checked: until then, and for ever if
    a rule is broken or a file cannot be read, the store is that of the load before.
    """
    with versions.replacing(spark, root) as folder:
        rows = {
            table: csv_files.ingest(spark, f"{texts}/{table}.csv", table, f"{folder}/{table}")
            for table in TABLES
        }
        quality.enforce(_star(rows), Config())


def opened(spark: SparkSession, root: str) -> Star:
    """The tables of the latest load that kept the rules."""
    folder = versions.current(spark, root)
    return _star({t: csv_files.accepted(spark, t, f"{folder}/{t}") for t in TABLES})


def _star(rows: dict) -> Star:
    return Star(rows["fact_sales"], rows["dim_customers"], rows["dim_products"])


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="starmart")
    commands = parser.add_subparsers(dest="command", required=True)

    command = commands.add_parser("load", help="replace the tables with the rows of CSV files")
    command.add_argument("texts")
    command.add_argument("root")

    commands.add_parser("list", help="names of the queries")

    command = commands.add_parser("expire", help="remove all loads but the last ones")
    command.add_argument("root")
    command.add_argument("--keep", type=int, default=2)

    command = commands.add_parser("run", help="show or store the result of one query")
    command.add_argument("name", choices=sorted(OPERATORS), metavar="name")
    command.add_argument("root")
    command.add_argument("--set", action="append", default=[], metavar="name=value")
    command.add_argument("--to", help="Parquet folder for the whole result")
    command.add_argument("--rows", type=int, default=50, help="rows to show without --to (50)")

    command = commands.add_parser("reports", help="store both reports")
    command.add_argument("root")
    command.add_argument("target")
    command.add_argument("--set", action="append", default=[], metavar="name=value")

    given = parser.parse_args(arguments)
    if given.command == "list":
        print("\n".join(OPERATORS))
        return
    spark = SparkSession.builder.appName("starmart").getOrCreate()
    if given.command == "load":
        load(spark, given.texts, given.root)
    elif given.command == "expire":
        print("\n".join(versions.expire(spark, given.root, given.keep)))
    elif given.command == "reports":
        views.materialise(opened(spark, given.root), _config(given.set), given.target)
    else:
        result = OPERATORS[given.name](opened(spark, given.root), _config(given.set))
        if given.to:
            result.write.mode("overwrite").parquet(given.to)
        else:
            result.show(given.rows, truncate=False)


if __name__ == "__main__":
    main()
