"""Ranks over groups too large for one task.

A window function needs its whole group in one task. Here rows are evaluated once into
a stored table and reduced to distinct values and their numbers, so that a run of ties
is one row. The values are cut at boundaries into as many slices as their number asks
for; each slice is ranked by itself and shifted by the rows of the slices before it.
Rows then look their rank up by value. Every step reads the stored tables.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmart.sources.storage import kept

#: Distinct values that one window may hold.
SLICE_VALUES = 200_000


def boundaries(values: DataFrame, value: str, slices: int) -> list:
    """At most ``slices`` - 1 values that cut ``values`` into about equal parts.

    One small job; what it returns is bounded, and used as literals, so the slice
    of a row depends on nothing but the row.
    """
    if slices < 2:
        return []
    shares = [i / slices for i in range(1, slices)]
    found = values.agg(F.percentile_approx(value, shares, 10 * slices)).first()[0]
    return sorted(set(found or []))


def _slice(value: str, bounds: list) -> Column:
    """Number of a value's slice: higher values have lower numbers, NULLs the last."""
    below = F.lit(0)
    if bounds:
        # Found by halves: a literal array is searched once, not compared bound by bound.
        places = F.transform(F.array(*map(F.lit, bounds)), lambda b: (F.col(value) <= b).cast("int"))
        below = F.aggregate(places, F.lit(0), lambda total, one: total + one)
    return F.coalesce(F.when(F.col(value).isNotNull(), below), F.lit(len(bounds) + 1))


def _same(names: list[str], prefix: str) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in names])


def _ranked_values(values: DataFrame, value: str, name: str, by: list[str], bounds: list) -> DataFrame:
    """Every distinct value with its rank, as columns that start with ``_at_``."""
    sliced = values.withColumn("_slice", _slice(value, bounds))
    keys = [*by, "_slice"]
    above = Window.partitionBy(*keys).orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("_above", F.coalesce(F.sum("_rows").over(above), F.lit(0)))
    # One row per slice and group.
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        sliced.groupBy(*keys)
        .agg(F.sum("_rows").alias("_held"))
        .withColumn("_before", F.coalesce(F.sum("_held").over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_before")
    )
    return ranked.join(starts, _same(keys, "_of_")).select(
        *[F.col(c).alias(f"_at_{c}") for c in [*by, value]],
        (F.col("_before") + F.col("_above") + 1).alias(name),
    )


def rank_descending(
    rows: DataFrame,
    value: str,
    name: str,
    by: list[str] | None = None,
    slice_values: int | None = None,
) -> DataFrame:
    """``RANK`` by ``value`` from high to low, within ``by``; NULLs come last.

    Runs when it is called: ``rows`` are stored, and if they are more than one window
    may hold, so are their distinct values. A group small enough is ranked in one task.
    """
    by, slice_values = by or [], slice_values or SLICE_VALUES
    table, count = kept(rows, "ranked")
    distinct = table.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_rows"))
    if count > slice_values:
        distinct, count = kept(distinct, "values")
    if count <= slice_values:
        window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(value).desc())
        before = F.sum("_rows").over(window.rowsBetween(Window.unboundedPreceding, -1))
        ranks = distinct.select(
            *[F.col(c).alias(f"_at_{c}") for c in [*by, value]],
            (F.coalesce(before, F.lit(0)) + 1).alias(name),
        )
    else:
        bounds = boundaries(distinct, value, math.ceil(count / slice_values))
        ranks = _ranked_values(distinct, value, name, by, bounds)
    return table.join(ranks, _same([*by, value], "_at_")).select(*table.columns, name)
