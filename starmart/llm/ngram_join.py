"""N-gram Jaccard join by vertical partitioning.

Word shingles are hashed; the order of the hashes is the global order of n-grams,
and fragments are ranges of it. Overlaps are counted in each fragment separately
and summed, once to find the documents that can have a partner at all, and once
per candidate pair to decide it.

1. Every document sends its shingles to their fragments. A fragment says which of
   them another document has. A document goes on only if, over all fragments, as
   many are shared as the least similarity asks for.
2. Documents with the same shingles become one class. The classes that go on are
   stored as segments: one row per class and fragment.
3. Two classes can only be similar if they share one of the rarest shingles of
   both, as many as the similarity lets differ, plus one. Shingles whose first and
   last class are the same make one family, so that edited copies, which share many
   shingles, meet once or a few times and not at each of them. Members of a family
   are compared with its hubs: first one hub, then sixteen, then 4,096, and so on.
   Members that have become one component are not compared any more, so
   a large group of near copies costs one comparison per member.
   A pair must also pass a bound on its overlap that follows from 2,048 bits of
   each class. Classes go by numbers here.
4. Pairs are first held against the overlap of their rarest shingles. For those that
   remain the overlaps of their segments are summed; links are merged into
   components.

Nothing is dropped: groups go on until every pair in different components has
been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm.common import runs_on_executors, stored, whole

runs_on_executors(__name__)

WORDS = 5
PERCENT = 75
BATCH_BYTES = 4_000_000
BATCH_TEXTS = 60_000
CHUNK_BYTES = 500_000
#: Classes up to WHOLE shingles are searched by all of them, those from HALF on by
#: the lower half of the order. Two similar classes are both in one of the groups,
#: since 0.75 * WHOLE < HALF. If any class has so little in the lower half that a
#: similar one may have none of it, all classes are searched by all their shingles.
HALF, WHOLE = 256, 340
SEGMENTS = 8
SIGNATURE_BITS = 2048
#: Fragments hold the shingles of about this much text.
FRAGMENT_BYTES = 32_000_000
LEAST_FRAGMENTS = 64
BITMAP_BITS = 26
HUB_GROWTH = 16
_HALF_MASK = 0x5DEECE66D1234567
_LOW = np.uint64(1 << 63)
_MASK48 = np.uint64((1 << 48) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(256, dtype=np.uint64)
_IS_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_FOLDED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + np.uint64(32), _BYTES)
_VALUES = np.where(_IS_BLANK, np.uint64(0), _mixed(_FOLDED + np.uint64(1)))
_FACTORS = _mixed(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block of UTF-8 bytes."""
    texts = len(offsets) - 1
    none = np.empty(0, np.uint64)
    blank = _IS_BLANK[data]
    begins = np.empty(len(data), bool)
    begins[:1] = True
    begins[1:] = blank[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins & ~blank)
    if not len(starts):
        return [none] * texts
    word = np.zeros(len(data), np.int32)
    word[starts] = 1
    word = np.cumsum(word, dtype=np.int32) - 1
    place = np.arange(len(data), dtype=np.int32) - starts.astype(np.int32)[np.maximum(word, 0)]
    place[blank | (place < 0)] = 0
    powers = np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    hashed = _mixed(np.add.reduceat(_VALUES[data] * powers[place], starts))
    first = np.searchsorted(starts, offsets)
    runs = max(0, len(hashed) - WORDS + 1)
    sums = np.zeros(runs, np.uint64)
    for j in range(WORDS):
        sums += hashed[j : j + runs] * _FACTORS[j]
    grams = _mixed(sums)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= WORDS:
            out.append(np.unique(grams[lo : hi - WORDS + 1]))
        elif hi > lo:
            short = (hashed[lo:hi] * _FACTORS[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mixed(short + np.uint64(hi - lo)))
        else:
            out.append(none)
    return out


def set_key(tokens: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    two = (_mixed(tokens).sum(dtype=np.uint64), _mixed(tokens + np.uint64(7)).sum(dtype=np.uint64))
    return np.array(two, np.uint64).tobytes()


def signature(tokens: np.ndarray) -> np.ndarray:
    """Bits that tell for each remainder whether an odd number of shingles has it.

    Where two sets' bits differ, at least one shingle is in one set only.
    """
    places = (tokens & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64)
    odd = np.bincount(places, minlength=SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch, each of about ``BATCH_BYTES``, with the shingles of their texts."""
    text = batch.column("text").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][: len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)

    def cut(at: int, stop: int, size: int) -> int:
        return min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + size))), stop)

    at = 0
    while at < len(text):
        end = cut(at, min(at + BATCH_TEXTS, len(text)), BATCH_BYTES)
        sets: list[np.ndarray] = []
        while at + len(sets) < end:
            first = at + len(sets)
            span = offsets[first : cut(first, end, CHUNK_BYTES) + 1]
            sets += shingles(data[span[0] : span[-1]], span - span[0])
        yield batch.slice(at, end - at), sets
        at = end


def _packed(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


_SENT = "fragment int, block bigint, single binary, of binary, several binary, own binary, head binary"
_HEAD = np.dtype(
    [("doc_id", "<i8"), ("known", "?"), ("row", "<i8"), ("n", "<i4"), ("low", "<i4"), ("key", "V16")]
)


def _send(fragments: int):
    """Rows for the fragments: a block's shingles, those of several texts only once.

    ``own`` lists the texts (by place in the block) of shingles that are shared
    inside the block; ``head``, in one of the rows, describes the block's texts.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for part, sets in _blocks(batch):
                block = (TaskContext.get().partitionId() << 32) | number
                number += 1
                ids = part.column("doc_id")
                head = np.zeros(len(sets), _HEAD)
                head["doc_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
                head["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
                head["row"] = part.column("row").to_numpy()
                head["n"] = [len(s) for s in sets]
                head["low"] = [np.searchsorted(s, _LOW) for s in sets]
                head["key"] = [np.void(set_key(s)) for s in sets]
                sent = [s if len(s) <= WHOLE else s[:low] for s, low in zip(sets, head["low"], strict=True)]
                tokens = np.concatenate(sent)
                of = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sent])
                order = np.argsort(tokens, kind="stable")
                tokens, of = tokens[order], of[order]
                new = np.ones(len(tokens), bool)
                new[1:] = tokens[1:] != tokens[:-1]
                again = np.ones(len(tokens), bool)
                again[:-1] = new[1:]
                alone = new & again
                kinds = [alone, new & ~alone, ~alone]
                cuts = np.array([(f << 64) // fragments for f in range(1, fragments)], np.uint64)
                ends = [[0, *np.searchsorted(tokens[k], cuts).tolist(), int(k.sum())] for k in kinds]
                lists = [tokens[kinds[0]], of[kinds[0]], tokens[kinds[1]], of[kinds[2]]]
                rows = []
                for f in range(fragments):
                    (a, b), (c, d), (g, h) = ((e[f], e[f + 1]) for e in ends)
                    if b == a and h == g and f != block % fragments:
                        continue
                    rows.append(
                        (
                            f,
                            block,
                            _packed(lists[0][a:b] & _MASK48),
                            lists[1][a:b].tobytes(),
                            _packed(lists[2][c:d] & _MASK48),
                            lists[3][g:h].tobytes(),
                            head.tobytes() if f == block % fragments else None,
                        )
                    )
                names = [x.split()[0] for x in _SENT.split(", ")]
                columns = list(zip(*rows, strict=True))
                types = [pa.int32(), pa.int64()] + [pa.binary()] * 5
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return send


def _share(frame: pd.DataFrame) -> pd.DataFrame:
    """For each block, the texts of its shingles that are shared, in this fragment."""
    single = [_unpacked(x) for x in frame["single"]]
    several = [_unpacked(x) for x in frame["several"]]
    every = np.sort(np.concatenate([*single, *several]))
    common = np.unique(every[1:][every[1:] == every[:-1]])
    shared = []
    for tokens, of, own in zip(single, frame["of"], frame["own"], strict=True):
        at = np.searchsorted(common, tokens)
        hit = common[np.minimum(at, len(common) - 1)] == tokens if len(common) else np.zeros(len(tokens), bool)
        shared.append(np.frombuffer(of, np.uint16)[hit].tobytes() + own)
    return pd.DataFrame(
        {"fragment": frame["fragment"], "block": frame["block"], "shared": shared, "head": frame["head"]}
    )


def _add_up(fragments: int):
    """Sums the overlaps of a block's texts over the fragments."""

    def add_up(frame: pd.DataFrame) -> pd.DataFrame:
        head = np.frombuffer(next(h for h in frame["head"] if h is not None), _HEAD)
        low, all_ = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        for fragment, shared in zip(frame["fragment"], frame["shared"], strict=True):
            counts = np.bincount(np.frombuffer(shared, np.uint16), minlength=len(head))
            all_ += counts
            if fragment < fragments // 2:
                low += counts
        may_differ = head["n"] * (100 - PERCENT) // 100
        goes_on = (head["n"] <= WHOLE) & (all_ >= head["n"] - may_differ)
        goes_on |= (head["n"] >= HALF) & (low >= head["low"] - may_differ)
        return pd.DataFrame(
            {
                "doc_id": head["doc_id"],
                "known": head["known"],
                "row": head["row"],
                "n": head["n"].astype(np.int64),
                "key": [k.tobytes() for k in head["key"]],
                "goes_on": goes_on & (head["n"] > 0),
            }
        )

    return add_up


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); ``row`` stands for id and text together."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return slim.select("doc_id", row_key("doc_id", "text").alias("row"), "text")


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), whole(F.col(text)))


def catalogue(docs: DataFrame, fragments: int) -> DataFrame:
    """(doc_id, row, n, key, goes_on) of every row: size and key of its set of shingles."""
    sent = _rows(docs).mapInArrow(_send(fragments), _SENT)
    shared = sent.groupBy("fragment").applyInPandas(
        _share, "fragment int, block bigint, shared binary, head binary"
    )
    rows = shared.groupBy("block").applyInPandas(
        _add_up(fragments),
        "doc_id bigint, known boolean, row bigint, n bigint, key binary, goes_on boolean",
    )
    return rows.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")


def _bitmap(rows: DataFrame) -> np.ndarray:
    """A fixed number of bits, set where a row's hash falls; false hits do no harm."""
    place = F.pmod(F.col("row"), F.lit(1 << BITMAP_BITS)).alias("p")
    bits = rows.select(place).selectExpr(
        "cast(p div 64 as int) as w", "shiftleft(1L, cast(p % 64 as int)) as b"
    )
    words = bits.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _segments(bits: np.ndarray):
    """The segments of the texts whose row is in the bitmap."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("row").to_numpy() & ((1 << BITMAP_BITS) - 1)
            hit = (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            for _, sets in _blocks(batch.filter(pa.array(hit.astype(bool)))):
                cuts = np.arange(1, SEGMENTS, dtype=np.uint64) << np.uint64(61)
                ends = [[*np.searchsorted(s, cuts).tolist(), len(s)] for s in sets]
                sizes = np.diff(np.array(ends), axis=1, prepend=0)
                first = (sizes > 0) & (np.cumsum(sizes > 0, axis=1) == 1)
                signed = (signature(s) for s in sets)
                values = np.concatenate(sets).view(np.int64)
                offsets = np.append(0, np.cumsum(sizes.ravel())).astype(np.int32)
                low = sizes[:, : SEGMENTS // 2].sum(axis=1)
                columns = {
                    "key": pa.array([k for s in sets for k in [set_key(s)] * SEGMENTS], pa.binary()),
                    "n": pa.array(np.repeat(sizes.sum(axis=1), SEGMENTS)),
                    "low": pa.array(np.repeat(low, SEGMENTS)),
                    "segment": pa.array(np.tile(np.arange(SEGMENTS, dtype=np.int32), len(sets))),
                    "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    "signature": pa.array(
                        [bits if here else None for bits, places in zip(signed, first, strict=True) for here in places],
                        pa.list_(pa.int64()),
                    ),
                }
                made = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                yield made.filter(pa.array(sizes.ravel() > 0))

    return segments


def _rare_shingles(segments: DataFrame) -> DataFrame:
    """(key, n, half, base, alone, last, prefix): each class's rarest shingles.

    Shingles are ordered by the number of classes that have them, then by hash. Of
    two similar classes at most a quarter of either's shingles are not in the
    other, so the first common one is among the first quarter and one of both.
    ``base`` is the number of shingles that are ordered; ``alone`` of them no other
    class has. ``prefix`` has the shared ones that follow, ``last`` is the place of
    the last in the order. Shingles of the two views are told apart by a bit pattern.
    """
    # Of the lower half a similar class may lack a quarter of all shingles, not more.
    weak = (F.col("n") >= HALF) & (100 * F.col("low") <= (100 - PERCENT) * F.col("n"))
    halves = segments.where(weak).isEmpty()
    views = F.array(
        F.when((F.col("n") <= WHOLE) | F.lit(not halves), F.struct(F.lit(0).cast("bigint").alias("mask"), F.col("n").alias("base"))),
        F.when(
            F.lit(halves) & (F.col("n") >= HALF) & (F.col("segment") < SEGMENTS // 2),
            F.struct(F.lit(_HALF_MASK).alias("mask"), F.col("low").alias("base")),
        ),
    )
    viewed = segments.withColumn("view", F.explode(F.array_compact(views)))
    tokens = viewed.select("key", "n", "view", F.explode("tokens").alias("token")).select(
        "key", "n", "view.mask", "view.base", F.col("token").bitwiseXOR(F.col("view.mask")).alias("token")
    )
    several = tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    shared = tokens.join(several, "token")
    per_class = shared.groupBy("key", "n", "mask", "base").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared")
    )
    alone = F.col("base") - F.size("shared")
    room = F.floor(F.col("n") * (100 - PERCENT) / 100) + 1 - alone
    first = F.slice("shared", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
    cut = per_class.select(
        "key", "n", (F.col("mask") != 0).alias("half"), "base", alone.alias("alone"), first.alias("s")
    )
    return cut.where(F.size("s") > 0).select(
        "key", "n", "half", "base", "alone",
        F.element_at("s", -1).alias("last"), F.col("s.token").alias("prefix"),
    )


def _needed(a: str, b: str) -> Column:
    """How many ordered shingles two similar classes have in common at least.

    Similar sets of n and m shingles have 3/7 (n + m) in common; of the ordered
    ones each has at most its own rest that the other lacks.
    """
    n, m, base, base_m = (F.col(c) for c in (f"n{a}", f"n{b}", f"base{a}", f"base{b}"))
    common = F.ceil(PERCENT * (n + m) / (100 + PERCENT))
    return F.greatest(base - n + common, base_m - m + common)


def _may_be_similar() -> Column:
    """Whether a pair can still be similar if no shingle before its places is common."""
    n, m = F.col("n"), F.col("n_a")
    rest = F.least(F.col("base") - F.col("place"), F.col("base_a") - F.col("place_a"))
    sizes = 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)
    return sizes & (rest >= _needed("", "_a"))


def _bits_agree() -> Column:
    """Whether the signatures of a pair leave room for the overlap of similar sets.

    Of n and m shingles with ``both`` in common n + m - 2 both are in one set only,
    no fewer than bits that differ.
    """
    n, m = F.col("n"), F.col("n_a")
    bits = F.zip_with("signature", "signature_a", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    common = F.ceil(PERCENT * (n + m) / (100 + PERCENT))
    return F.aggregate(bits, F.lit(0), lambda total, differ: total + differ) <= n + m - 2 * common


def _promising(pairs: DataFrame, rare: DataFrame) -> DataFrame:
    """The pairs that the overlap of their rarest shingles does not rule out.

    Up to the prefix that ends first in the order, common shingles are in both
    prefixes; beyond it are at most the rest of that class. Similar classes have a
    shingle of their prefixes in common, which members of a family need not have.
    """
    side = lambda of: rare.select(
        F.col("id").alias(of),
        F.col("half").alias(f"half_{of}"),
        F.col("base").alias(f"base_{of}"),
        (F.col("base") - F.col("alone") - F.size("prefix")).alias(f"rest_{of}"),
        F.col("last").alias(f"last_{of}"),
        F.col("prefix").alias(f"prefix_{of}"),
    )
    met = pairs.join(side("a"), "a").where(F.col("half") == F.col("half_a"))
    met = met.join(side("b"), "b").where(F.col("half") == F.col("half_b"))
    rest = F.when(F.col("last_a") <= F.col("last_b"), F.col("rest_a")).otherwise(F.col("rest_b"))
    both = F.size(F.array_intersect("prefix_a", "prefix_b"))
    enough = (both > 0) & (both + rest >= _needed("_a", "_b"))
    return met.where(enough).select(*pairs.columns).drop("half").distinct()


def overlaps(pairs: DataFrame, segments: DataFrame, numbered: DataFrame) -> DataFrame:
    """``pairs`` of (a, b) with ``both``: their overlaps, counted by segment and summed.

    Only classes that occur in a pair are read from the segments. These come as one
    row a class with its segments side by side, so a pair stays one row.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = stored(ends.join(numbered.select("id", "key"), "id"), "wanted")
    found = segments.join(wanted, "key")
    token_lists = [
        F.coalesce(
            F.max(F.when(F.col("segment") == i, F.col("tokens"))), F.array().cast("array<bigint>")
        ).alias(f"s{i}")
        for i in range(SEGMENTS)
    ]
    side = found.groupBy("id").agg(*token_lists)
    names = [f"s{i}" for i in range(SEGMENTS)]
    of = lambda end: side.select(
        F.col("id").alias(end), *[F.col(n).alias(f"{end}_{n}") for n in names]
    )
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    parts = [F.size(F.array_intersect(f"a_{n}", f"b_{n}")) for n in names]
    return met.select(*pairs.columns, sum(parts[1:], parts[0]).cast("bigint").alias("both"))


def _linked(pairs: DataFrame, segments: DataFrame, numbered: DataFrame) -> DataFrame:
    either = F.col("n_a") + F.col("n_b") - F.col("both")
    return overlaps(pairs, segments, numbered).where(100 * F.col("both") >= PERCENT * either)


def connect(edges: DataFrame) -> DataFrame:
    """(u, v): every node of ``edges`` (u > v) but the smallest of its component, which is v.

    Each pass hangs the neighbours of a node on the smallest one (large stars, then
    small stars) until nothing changes.
    """
    edges = stored(edges.select("u", "v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        hung = both.join(least, "u").where(F.col("v") > F.col("u"))
        large = hung.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u").where(F.col("v") != F.col("m"))
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionAll(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = tuple(edges.agg(F.count("*"), total).first())
        if now == mark:
            return edges
        mark = now


def _numbered(segments: DataFrame, found: DataFrame) -> DataFrame:
    """(id, key, n, low, signature) of each class that has rare shingles.

    Ids follow the share of shingles that no other class has: classes with few of their
    own, what others were copied from, come first and are the first hubs.
    """
    signed = segments.where(F.col("signature").isNotNull()).select("key", "n", "low", "signature")
    own = found.groupBy("key").agg(F.min(F.col("alone") / F.col("base")).alias("own"))
    return (
        signed.join(own, "key")
        .orderBy("own", "key")
        .select(F.monotonically_increasing_id().alias("id"), "key", "n", "low", "signature")
    )


def _families(rare: DataFrame) -> DataFrame:
    """(family, half, id, place): classes with a rare shingle in common are in one family.

    Shingles whose first and last class are the same make one family. ``place`` is
    that of a class's first shingle in it, so none before it leads to another member.
    """
    listed = rare.select(
        "id", "half", "alone", F.posexplode("prefix").alias("at", "token")
    ).select("token", "id", "half", (F.col("alone") + F.col("at")).alias("place"))
    ends = listed.groupBy("token").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    met = listed.join(ends.where(F.col("first") != F.col("last")), "token")
    family = F.xxhash64("first", "last").alias("family")
    return met.groupBy(family, "half", "id").agg(F.min("place").alias("place"))


def _components(segments: DataFrame) -> DataFrame:
    """(key, component): classes that are linked, directly or not, share a component."""
    found = stored(_rare_shingles(segments), "found")
    numbered = stored(_numbered(segments, found), "numbered")
    ids = numbered.select("id", "key")
    rarest = stored(found.join(ids, "key").drop("key"), "rare")
    listed = stored(_families(rarest), "families")
    labels = stored(numbered.select("id", F.col("id").alias("component")), "labels")
    tested = segments.sparkSession.createDataFrame([], "a bigint, b bigint")
    seen, hubs, growth = 0, 1, HUB_GROWTH
    while True:
        members = listed.join(labels, "id")
        ends = [f(F.col("component")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        groups = members.groupBy("family", "half").agg(*ends, F.count("*").alias("c"))
        open_groups = groups.where(F.col("lo") != F.col("hi")).select("family", "half", "c")
        members = stored(members.join(open_groups, ["family", "half"]), "members")
        largest = members.agg(F.max("c")).first()[0]
        if largest is None:
            break
        listed = members.select(*listed.columns)
        place = F.row_number().over(Window.partitionBy("family", "half").orderBy("id"))
        chosen = members.withColumn("number", place).where(F.col("number") <= hubs)
        traits = numbered.select("id", "n", "low", "signature")
        described = lambda rows: rows.join(traits, "id").withColumn(  # noqa: E731, B023
            "base", F.when(F.col("half"), F.col("low")).otherwise(F.col("n"))
        )
        names = {"id": "a", "n": "n_a", "base": "base_a", "place": "place_a", "component": "u"}
        names |= {"family": "of", "half": "half_a", "signature": "signature_a"}
        hub = described(chosen.where(F.col("number") > seen)).select(
            *[F.col(c).alias(to) for c, to in names.items()]
        )
        same = (F.col("family") == F.col("of")) & (F.col("half") == F.col("half_a"))
        new = (F.col("a") < F.col("id")) & (F.col("u") != F.col("component")) & _may_be_similar()
        pairs = (
            described(members)
            .join(hub, same & new & _bits_agree())
            .select(
                "a",
                F.col("id").alias("b"),
                "n_a",
                F.col("n").alias("n_b"),
                F.least("u", "component").alias("v"),
                F.greatest("u", "component").alias("u"),
                "half",
            )
            .distinct()
            .join(tested, ["a", "b"], "left_anti")
        )
        pairs = stored(pairs, "candidates")
        tested = tested.unionAll(pairs.select("a", "b").distinct())
        pairs = stored(_promising(pairs, rarest), "pairs")
        links = stored(_linked(pairs, segments, numbered).select("u", "v").distinct(), "links")
        if not links.isEmpty():
            moved = connect(links).select(F.col("u").alias("component"), F.col("v").alias("to"))
            labels = stored(
                labels.join(moved, "component", "left").select(
                    "id", F.coalesce("to", "component").alias("component")
                ),
                "labels",
            )
        if hubs >= largest - 1:
            break
        seen, hubs, growth = hubs, hubs * growth, growth**2
    of_component = ids.select(F.col("id").alias("component"), F.col("key").alias("name"))
    named = labels.join(ids, "id").join(of_component, "component")
    return named.select("key", F.col("name").alias("component"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, first) of every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their shingles is at least
    ``PERCENT``; ``component_id`` is the smallest id that links reach, ``first`` is
    true for the row that stands for its component (smallest id, rows without an id
    last). Null, empty and blank texts have no shingles and no links: each is its
    own component, with its own id. A component without any id has null. Rows equal
    in id and text are all first or none. Other columns of ``docs`` are not read.
    Without documents there are no rows.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, 2 * (size // (2 * FRAGMENT_BYTES)))
    rows = stored(catalogue(docs, fragments), "catalogue")
    worded = rows.where(F.col("n") > 0)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    classes = stored(
        worded.groupBy("key").agg(F.min(order).alias("least"), F.max("goes_on").alias("goes_on")),
        "classes",
    )
    going = classes.where("goes_on").select(F.col("least.row").alias("row"))
    bits = _bitmap(going)
    made = _rows(docs).mapInArrow(
        _segments(bits), "key binary, n bigint, low bigint, segment int, tokens array<bigint>, signature array<bigint>"
    )
    segments = stored(made.dropDuplicates(["key", "segment"]), "segments")
    labels = stored(_components(segments), "labels")

    of_class = classes.join(labels, "key", "left").select(
        "key", F.coalesce("component", "key").alias("component"), "least"
    )
    best = of_class.groupBy("component").agg(F.min("least").alias("best"))
    found = stored(of_class.join(best, "component").select("key", "best"), "components")
    with_words = worded.join(found, "key").select(
        "doc_id",
        "row",
        F.col("n").alias("n_shingles"),
        F.col("best.doc_id").alias("component_id"),
        (order == F.col("best")).alias("first"),
    )
    without = rows.where(F.col("n") == 0).select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.lit(True).alias("first"),
    )
    return with_words.unionAll(without)


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with the same columns.

    Of rows equal in id and text one stays, unless they have no words.
    """
    firsts = similar_groups(docs).where("first")
    kept = firsts.select(
        F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_row"), "n_shingles"
    ).distinct()
    packed = docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.col("doc_id").cast("long").alias("id"),
        row_key("doc_id", "text").alias("row"),
    )
    same = (F.col("row") == F.col("kept_row")) & F.col("id").eqNullSafe(F.col("kept_id"))
    place = F.row_number().over(Window.partitionBy("row", "id").orderBy("row"))
    found = packed.join(kept, same).withColumn("place", place)
    return found.where((F.col("place") == 1) | (F.col("n_shingles") == 0)).select("doc.*")
