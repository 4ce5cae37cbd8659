"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, bytes are added up per slot, and
a versioned map says which shard holds a slot. Rebalancing writes the next
version of the map: it moves slots and never rehashes a record.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starmart.llm.common import stored, whole
from starmart.sources.storage import exists

SLOTS = 16_384
SHARDS = 40
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """Shard of each slot; the length is the fixed number of slots."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def first(slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
        """Version 1, before any size is known: slots in turn."""
        return SlotMap(1, shards, tuple(slot % shards for slot in range(slots)))

    def rebalanced(self, size_of: Sequence[int], shards: int | None = None) -> SlotMap:
        """The next version, for these slot sizes and perhaps another number of shards.

        Shards above the mean give up slots, smallest first, until they are at or
        below it; the freed slots go, largest first, to the shard that is lightest.
        """
        shards = shards or self.shards
        mean = sum(size_of) / shards
        held: list[list[int]] = [[] for _ in range(shards)]
        free = []
        for slot, shard in enumerate(self.shard_of):
            (held[shard] if shard < shards else free).append(slot)
        load = [sum(size_of[slot] for slot in slots) for slots in held]
        for shard, slots in enumerate(held):
            slots.sort(key=lambda slot: (-size_of[slot], slot))
            while load[shard] > mean and len(slots) > 1:
                free.append(slots.pop())
                load[shard] -= size_of[free[-1]]
        edited = list(self.shard_of)
        lightest = [(load[shard], shard) for shard in range(shards)]
        heapq.heapify(lightest)
        for slot in sorted(free, key=lambda slot: (-size_of[slot], slot)):
            load_, shard = heapq.heappop(lightest)
            edited[slot] = shard
            heapq.heappush(lightest, (load_ + size_of[slot], shard))
        return SlotMap(self.version + 1, shards, tuple(edited))

    def rows(self, spark: SparkSession) -> DataFrame:
        """(version, shards, virtual_slot, shard), one row per slot."""
        return spark.createDataFrame(
            [(self.version, self.shards, i, s) for i, s in enumerate(self.shard_of)],
            "version int, shards int, virtual_slot int, shard int",
        )

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to the stored ones."""
        self.rows(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest if none is named; as many rows as slots."""
        stored_maps = spark.read.parquet(folder)
        version = version or stored_maps.agg(F.max("version")).first()[0]
        rows = stored_maps.where(F.col("version") == version).orderBy("virtual_slot").collect()
        return SlotMap(version, rows[0]["shards"], tuple(row["shard"] for row in rows))


def virtual_slot(doc_id: Column, text: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int")


def measure(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row."""
    text = whole(F.col("text"))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), text, slots).alias("virtual_slot"),
    )


def slot_table(measured: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; at most ``slots`` rows reach the driver."""
    sizes, counts = [0] * slots, [0] * slots
    sums = measured.groupBy("virtual_slot").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    for row in sums.collect():
        sizes[row["virtual_slot"]], counts[row["virtual_slot"]] = row["s"], row["n"]
    return sizes, counts


def place(measured: DataFrame, slot_map: SlotMap, counts: Sequence[int]) -> DataFrame:
    """``measured`` with ``shard`` and ``slot``: the row's place in its shard, from 0.

    Rows are numbered inside their virtual slot; the slots before it in the same
    shard say where its numbers start. The broadcast table has one row per slot.
    """
    start, starts = [0] * slot_map.shards, []
    for virtual, shard in enumerate(slot_map.shard_of):
        starts.append((virtual, shard, start[shard]))
        start[shard] += counts[virtual]
    table = measured.sparkSession.createDataFrame(
        starts, "virtual_slot int, shard int, start bigint"
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        measured.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(table), "virtual_slot")
        .withColumn("slot", F.col("start") + F.col("inside"))
        .drop("start", "inside")
    )


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None
) -> DataFrame:
    """Every row's shard, so that shards have nearly equal bytes.

    With ``folder`` the latest map that is stored there is edited for the sizes of
    ``docs`` and for ``shards``, and stored as the next version; slots that the edit does
    not name stay where they are. Without one, or if none is stored yet, slots begin in
    turn. A text of null counts as empty. Rows equal in id and text share a virtual slot
    and get neighbouring places. An id of null is hashed like any other value. Other
    columns of ``docs`` are not read. Without documents there are no rows.
    """
    spark = docs.sparkSession
    before = SlotMap.first(slots, shards)
    if folder and exists(spark, folder):
        before = SlotMap.load(spark, folder)
        if len(before.shard_of) != slots:
            raise ValueError(f"the stored map has {len(before.shard_of)} slots, not {slots}")
    measured = stored(measure(docs, slots), "measured")
    sizes, counts = slot_table(measured, slots)
    slot_map = before.rebalanced(sizes, shards)
    if folder:
        slot_map.save(spark, folder)
    return place(measured, slot_map, counts).withColumn("map_version", F.lit(slot_map.version))
