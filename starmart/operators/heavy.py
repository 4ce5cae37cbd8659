"""Lookups in large dimensions where single keys hold a large part of the rows.

A join by shuffle brings all rows of a key to one task. Here the few keys that hold more
than a fixed share of the rows are found first; their rows of the dimension are
broadcast (their number is bounded by the share), and rows of these keys are dealt by
another column in place of the key. Only the rest meets the dimension by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.sources.storage import files

#: Keys with at least this share of all rows are heavy; there are at most 1 / SHARE of them.
SHARE = 0.001
#: Groups of hashes that are counted before single keys; a group has far less than SHARE by chance.
HASHES = 1 << 14
#: Dimensions whose files are smaller are left to Spark's own choice of join.
SMALL_DIMENSION = 10_000_000


def is_large(dimension: DataFrame) -> bool:
    """Whether a dimension is too large to be broadcast whole, by the size of its files."""
    folders = {name.rpartition("/")[0] for name in dimension.inputFiles()}
    return sum(length for _, _, length in files(dimension.sparkSession, sorted(folders))) > SMALL_DIMENSION


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """(key) of the keys that hold at least ``share`` of ``rows``; two scans of one column.

    A heavy key's group of hashes is as heavy. So groups are counted first, and single
    keys only within the few groups that hold that share.
    """
    known = rows.where(F.col(key).isNotNull()).select(key, F.pmod(F.xxhash64(key), F.lit(HASHES)).alias("_hash"))
    groups = known.groupBy("_hash").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.ceil(F.sum("n") * share), F.lit(2)).alias("_least")
    listed = groups.agg(least, F.collect_list(F.struct("_hash", "n")).alias("groups"))
    found = listed.select("_least", F.inline("groups")).where(F.col("n") >= F.col("_least"))
    counted = known.join(F.broadcast(found.drop("n")), "_hash").groupBy(key, "_least").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= F.col("_least")).select(key)


def looked_up(
    rows: DataFrame, key: str, dimension: DataFrame, source: DataFrame, spread: Column, how: str = "left"
) -> DataFrame:
    """``rows`` with the other columns of ``dimension``, joined by ``key`` (left or inner).

    ``key`` is unique in ``dimension``. ``source`` has the rows that keys are weighed by,
    and is read twice: best a stored table that ``rows`` come from. ``spread`` is a column of ``rows`` that deals the rows
    of a heavy key to many tasks.
    """
    if not is_large(dimension):
        return rows.join(dimension, key, how)
    names = [name for name in dimension.columns if name != key]
    heavy = heavy_keys(source, key)
    few = dimension.join(F.broadcast(heavy), key).withColumn("_known", F.lit(True))
    listed = heavy.join(F.broadcast(few), key, "left").select(
        F.col(key).alias("_heavy"), "_known", *[F.col(name).alias(f"_{name}") for name in names]
    )
    weighed = rows.join(F.broadcast(listed), F.col(key) == F.col("_heavy"), "left")
    # A number in place of a heavy or missing key; what it happens to meet is not used.
    is_heavy = F.col("_heavy").isNotNull()
    light = ~is_heavy & F.col(key).isNotNull()
    dealt = weighed.withColumn("_dealt", F.when(light, F.col(key)).otherwise(F.xxhash64(spread)))
    rest = dimension.withColumnRenamed(key, "_dealt").withColumn("_met", F.lit(True))
    joined = dealt.join(rest, "_dealt", "left")
    if how == "inner":
        joined = joined.where(F.coalesce(F.when(is_heavy, F.col("_known")).when(light, F.col("_met")), F.lit(False)))
    values = [
        F.when(is_heavy, F.col(f"_{name}")).when(light, F.col(name)).alias(name) for name in names
    ]
    return joined.select(*rows.columns, *values)
