"""Substring dedup over fixed-block anchors.

Words that a run of ``WINDOW`` words covers are removed where that run also starts in a
document with a smaller id. A run of so many words holds at least one whole block of
half as many, wherever the blocks of a document begin.

1. Copies of a whole text are told by their digest; the first one stands for them.
2. Index: the blocks of every document, side by side, as hashes.
3. Probe: every rolling window of a block's length, against the index. A window that is
   itself an indexed block is a hit only if the index has the block twice.
4. Extend: around hits, and around the blocks that were hit, windows of ``WINDOW`` words
   are compared by 96 bits of hashes, and the smallest document that has each is found.
   Windows in a row that a smaller document has make up a maximal repeat.

The index and the hits reach the tasks as bitmaps of a bounded size. A bit that is set
by chance, or a bitmap that is full, costs comparisons and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmart.llm.common import BLANK_RUN, BLANKS, fresh, let, runs_on_executors, stored, whole

runs_on_executors(__name__)

WINDOW = 50
BLOCK = WINDOW // 2
CHUNK_BYTES = 250_000
#: Texts that go to Python together, and those that are looked at to leave out copies.
BATCH_ROWS, SLICE = 1024, 512
#: Bits of a bitmap: some for each expected entry, within these bounds (128 MB at most).
LEAST_BITS, MOST_BITS = 22, 30
BITS_EACH, BYTES_A_BLOCK = 32, 150
#: Bits and bytes of one row of a bitmap, as Spark's bitmap functions make them, and
#: where in a hash the numbers of its bits begin.
ROW_BITS, ROW_BYTES = 32_768, 4096
SHIFTS = (0, 32, 47)
NO_ID = (1 << 63) - 1

_BYTES = np.arange(256, dtype=np.uint64)
_IS_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Odd numbers, so that they have an inverse modulo 2 ** 64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolled(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[begin:end] for many spans: differences of one running sum.

    Equal spans have equal hashes wherever they stand: the factor that belongs to the
    place is divided out by the inverse of the base.
    """
    ups, downs = _powers.get(base, (np.empty(0, np.uint64),) * 2)
    if len(ups) <= len(values):
        size = 1 << (len(values) + 1).bit_length()
        steps = [np.full(size, x % (1 << 64), np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for step in steps:
            step[0] = 1
        ups, downs = (np.cumprod(step, dtype=np.uint64) for step in steps)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = ups, downs
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * ups[: len(values)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[end] - sums[begin]) * downs[begin])


_VALUES = mixed(_BYTES + np.uint64(1))


class Words:
    """The words of a block of texts, as hashes, and windows over them.

    ``first`` is the place of each text's first word, ``text`` each word's text, and
    ``room`` how many words its text has from there on.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        blank = _IS_BLANK[data]
        begins, ends = (np.ones(len(data), bool) for _ in range(2))
        begins[1:], ends[:-1] = blank[:-1], blank[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        begins[cuts], ends[cuts - 1] = True, True
        starts = np.flatnonzero(begins & ~blank)
        stops = np.flatnonzero(ends & ~blank) + 1
        self.values = rolled(_VALUES[data], starts, stops, _BASES[0])
        self.first = np.searchsorted(starts, offsets)
        counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(starts)) - np.repeat(self.first[:-1], counts)
        self.room = np.repeat(counts, counts) - self.place

    def windows(self, size: int, base: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``size`` words of one text begin, and the hashes of these windows."""
        at = np.flatnonzero(self.room >= size)
        values = mixed(self.values ^ np.uint64(salt)) if salt else self.values
        return at, rolled(values, at, at + size, base)


def _parts(batches: Iterator[pa.RecordBatch], wanted: Callable) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches with the wanted rows, so that little is copied at a time."""
    for batch in batches:
        mask = pa.array(wanted(batch.column("place").to_numpy()))
        for at in range(0, len(mask), SLICE):
            yield batch.slice(at, SLICE).filter(mask.slice(at, SLICE))


def _chunks(batches: Iterator[pa.RecordBatch], wanted: Callable) -> Iterator[tuple[dict, Words]]:
    """The wanted texts in parts of about ``CHUNK_BYTES``: ids and words."""
    for batch in _parts(batches, wanted):
        text = batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][: len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        ids = batch.column("doc_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        doc_id = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        mark = batch.column("mark").to_numpy()
        at = 0
        while at < len(text):
            end = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES))
            end = min(max(at + 1, end), len(text))
            span = offsets[at : end + 1]
            of = {"doc_id": doc_id[at:end], "known": known[at:end], "mark": mark[at:end]}
            yield of, Words(data[span[0] : span[-1]], span - span[0])
            at = end


def _batch(schema: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _ids(doc_id: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(doc_id, mask=~known)


def _extremes(keys: list[np.ndarray], doc_id: np.ndarray, known: np.ndarray) -> tuple:
    """The different keys, with the smallest and largest id and whether one has no id."""
    rank = np.where(known, doc_id, NO_ID)
    order = np.lexsort((known, rank, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    start = np.flatnonzero(new)
    known, rank = known[order], rank[order]
    least = _ids(rank[start], known[start] | (rank[start] < NO_ID))
    loose = np.logical_or.reduceat(~known, start) if len(start) else np.zeros(0, bool)
    most = np.maximum.reduceat(np.where(known, rank, -NO_ID - 1), start) if len(start) else rank[:0]
    some = np.logical_or.reduceat(known, start) if len(start) else np.zeros(0, bool)
    return [key[order][start] for key in keys], least, _ids(most, some), loose


_BLOCKS = "h bigint, lo bigint, hi bigint, loose boolean"
_WINDOWS = "g bigint, g2 int, lo bigint, hi bigint, loose boolean"
_PLACES = "g bigint, g2 int, doc_id bigint, mark bigint, at int"


class Filter:
    """A bitmap that the tasks look hashes up in: ``SHIFTS`` bits of one row for each."""

    def __init__(self, shared, bits: int):
        self.shared, self.bits = shared, bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes.view(np.uint64)
        row = hashes & np.uint64((1 << self.bits) - ROW_BITS)
        found = np.arange(len(hashes))
        for shift in SHIFTS:
            at = row[found] | (hashes[found] >> np.uint64(shift)) & np.uint64(ROW_BITS - 1)
            byte = self.shared.value[at >> np.uint64(3)]
            found = found[(byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(hashes), bool)
        out[found] = True
        return out


def _index(wanted: Filter):
    """The blocks of each text, side by side."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, words in _chunks(batches, wanted):
            at, hashes = words.windows(BLOCK, _BASES[1])
            sided = words.place[at] % BLOCK == 0
            text = words.text[at[sided]]
            (h,), lo, hi, loose = _extremes([hashes[sided]], of["doc_id"][text], of["known"][text])
            yield _batch(_BLOCKS, h.view(np.int64), lo, hi, loose)

    return index


def _hits(words: Words, has: Filter, has_two: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, whether it is a hit, whether it is an indexed block of its own text)."""
    at, hashes = words.windows(BLOCK, _BASES[1])
    own = words.place[at] % BLOCK == 0
    hit = np.zeros(len(at), bool)
    hit[own], hit[~own] = has_two(hashes[own]), has(hashes[~own])
    return at, hashes, hit, own


def _probe(wanted: Filter, has: Filter, has_two: Filter):
    """The hashes of each text that are hits."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _chunks(batches, wanted):
            _, hashes, hit, _ = _hits(words, has, has_two)
            yield _batch("h", np.unique(hashes[hit]).view(np.int64))

    return probe


def _candidates(words: Words, has: Filter, has_two: Filter, was_hit: Filter):
    """Places and two hashes of the windows around hits and around blocks that were hit."""
    at, hashes, hit, own = _hits(words, has, has_two)
    hit[own] = was_hit(hashes[own])
    marked = np.zeros(len(words.values) + 1, np.int32)
    marked[at + 1] = hit
    marked = np.cumsum(marked, dtype=np.int32)
    whole_at = np.flatnonzero(words.room >= WINDOW)
    chosen = whole_at[marked[whole_at + WINDOW - BLOCK + 1] > marked[whole_at]]
    other = mixed(words.values ^ np.uint64(_BASES[2]))
    g = rolled(words.values, chosen, chosen + WINDOW, _BASES[2])
    g2 = rolled(other, chosen, chosen + WINDOW, _BASES[1])
    return chosen, g.view(np.int64), (g2 >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _compare(wanted: Filter, has: Filter, has_two: Filter, was_hit: Filter):
    """The candidate windows with the extremes of the ids that have them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, words in _chunks(batches, wanted):
            at, g, g2 = _candidates(words, has, has_two, was_hit)
            text = words.text[at]
            (g, g2), lo, hi, loose = _extremes([g, g2], of["doc_id"][text], of["known"][text])
            yield _batch(_WINDOWS, g, g2, lo, hi, loose)

    return compare


def _locate(wanted: Filter, has: Filter, has_two: Filter, was_hit: Filter, owned: Filter):
    """The places of the candidate windows that several documents have."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, words in _chunks(batches, wanted):
            at, g, g2 = _candidates(words, has, has_two, was_hit)
            several = owned(g)
            at, g, g2 = at[several], g[several], g2[several]
            text = words.text[at]
            ids = _ids(of["doc_id"][text], of["known"][text])
            yield _batch(_PLACES, g, g2, ids, of["mark"][text], words.place[at].astype(np.int32))

    return locate


def _bucket(bits: int) -> Column:
    """The row of a bitmap that a hash belongs to."""
    return F.shiftright(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), 15).cast("int")


def _filter(rows: DataFrame, bits: int, *flags: str) -> list[Filter]:
    """Bitmaps of the hashes ``h``; for each of ``flags`` one of the rows where it is true.

    ``rows`` are dealt by ``bucket``, so that a row of a bitmap is made in one task. All
    bitmaps but the first are for fewer hashes and are folded to a quarter.
    """
    places = [F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(ROW_BITS - 1)) for shift in SHIFTS]
    spread = rows.select("bucket", *flags, F.explode(F.array(*places)).alias("bit"))
    made = [F.bitmap_construct_agg(F.when(F.col(flag), F.col("bit"))).alias(flag) for flag in flags]
    table = spread.groupBy("bucket").agg(*made).toArrow()
    buckets = table.column("bucket").to_pylist()
    filters = []
    for flag in flags:
        bitmap = np.zeros(1 << bits >> 3, np.uint8)
        for bucket, part in zip(buckets, table.column(flag), strict=True):
            if part.is_valid:
                at = bucket * ROW_BYTES
                bitmap[at : at + ROW_BYTES] = np.frombuffer(part.as_buffer(), np.uint8)
        fold = 2 if filters and bits > LEAST_BITS else 0
        bitmap = np.bitwise_or.reduce(bitmap.reshape(1 << fold, -1), axis=0)
        filters.append(Filter(rows.sparkSession.sparkContext.broadcast(bitmap), bits - fold))
    return filters


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer texts at a time on their way to Python, while the jobs of the block run."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _dealt(rows: DataFrame, bits: int) -> DataFrame:
    return rows.withColumn("bucket", _bucket(bits)).repartition("bucket")


def _bits(expected: int) -> int:
    return min(max((expected * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)


def _rows_filter(rows: DataFrame) -> Filter:
    """A bitmap of rows (doc_id, mark)."""
    bits = _bits(rows.count())
    hashed = rows.select(_place(F.col("doc_id"), F.col("mark")).alias("h"), F.lit(True).alias("set"))
    return _filter(_dealt(hashed, bits), bits, "set")[0]


def _place(doc_id: Column, mark: Column) -> Column:
    return F.xxhash64(doc_id, mark, doc_id.isNull())


def _after(doc_id: Column, owner: Column) -> Column:
    """Whether a document comes after another; those without an id come after all that have one."""
    return owner.isNotNull() & F.coalesce(doc_id > owner, F.lit(True))


def _slim(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, place, text); ``mark`` tells apart rows of one id with different texts."""
    doc_id, text = F.col("doc_id").cast("bigint"), whole(F.col("text"))
    mark = F.xxhash64(text)
    return docs.select(
        doc_id.alias("doc_id"), mark.alias("mark"), _place(doc_id, mark).alias("place"), text.alias("text")
    )


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, place, copy, bytes): ``copy`` if the whole text is in a smaller document."""
    rows = stored(
        _slim(docs).select(
            "doc_id", "mark", "place", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("bytes")
        ),
        "digests",
    )
    several = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    several = stored(several.where((F.col("n") > 1) & F.col("least").isNotNull()), "copies")
    joined = rows.join(several.drop("n"), "digest", "left")
    copy = _after(F.col("doc_id"), F.col("least")).alias("copy")
    return stored(joined.select("doc_id", "mark", "place", copy, "bytes"), "judged")


def repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, mark, spans): the maximal repeats of each text that has some.

    ``rows`` are those of ``judged``; copies have no spans. ``spans`` are (begin, end) by
    number of words, without overlap: all words of windows that start in a document
    with a smaller id.
    """
    bits = _bits((rows.agg(F.sum("bytes")).first()[0] or 0) // BYTES_A_BLOCK)
    texts = _slim(docs)
    wanted = _rows_filter(rows.where(~F.col("copy")))

    blocks = _dealt(texts.mapInArrow(_index(wanted), _BLOCKS), bits).groupBy("bucket", "h")
    indexed = blocks.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("loose").alias("loose"))
    several = F.col("loose") | (F.col("hi") > F.col("lo"))
    one, two = F.col("lo").isNotNull(), F.col("lo").isNotNull() & several
    has, has_two = _filter(indexed.select("bucket", "h", one.alias("one"), two.alias("two")), bits, "one", "two")

    # Far fewer hashes are hits than there are blocks.
    fewer = max(bits - 2, LEAST_BITS)
    hits = _dealt(texts.mapInArrow(_probe(wanted, has, has_two), "h bigint"), fewer)
    (was_hit,) = _filter(hits.withColumn("set", F.lit(True)), fewer, "set")

    filters = (wanted, has, has_two, was_hit)
    windows = texts.mapInArrow(_compare(*filters), _WINDOWS).groupBy("g", "g2")
    owners = windows.agg(F.min("lo").alias("owner"), F.max("hi").alias("hi"), F.max("loose").alias("loose"))
    repeated = F.col("owner").isNotNull() & (F.col("loose") | (F.col("hi") > F.col("owner")))
    owners = stored(owners.where(repeated).select("g", "g2", "owner"), "owners")
    bits = _bits(owners.count())
    (owned,) = _filter(_dealt(owners.select(F.col("g").alias("h"), F.lit(True).alias("set")), bits), bits, "set")
    places = texts.mapInArrow(_locate(*filters, owned), _PLACES).join(owners, ["g", "g2"])
    later = places.where(_after(F.col("doc_id"), F.col("owner")))
    starts = later.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("at")).alias("s"))
    s = F.col("s")
    begins = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) < x - WINDOW, F.lit(True)))
    lasts = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1) > x + WINDOW, F.lit(True)))
    spans = F.transform(
        F.arrays_zip(begins.alias("b"), lasts.alias("e")),
        lambda r: F.struct(r["b"].alias("begin"), (r["e"] + WINDOW).alias("end")),
    )
    return stored(starts.select("doc_id", "mark", spans.alias("spans")), "spans")


def _kept(words: Column, spans: Column) -> Column:
    """``words`` without those of the spans."""
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
    between = F.transform(spans, lambda r, i: F.slice(words, before(i) + 1, r["begin"] - before(i)))
    end = F.element_at(spans, -1)["end"]
    rest = F.slice(words, end + 1, F.greatest(F.size(words) - end, F.lit(0)))
    return F.flatten(F.concat(between, F.array(rest)))


def _done(words: Column, copy: Column, spans: Column) -> Column:
    n, none = F.size(words), F.array().cast("array<string>")
    removed = F.aggregate(spans, F.lit(0), lambda total, r: total + r["end"] - r["begin"])
    gone = F.when(copy, F.when(n >= WINDOW, n).otherwise(0)).otherwise(F.coalesce(removed, F.lit(0)))
    kept = F.when(copy & (n >= WINDOW), none).when(~copy & spans.isNotNull(), _kept(words, spans)).otherwise(words)
    return F.struct(
        n.cast("long").alias("n_words"),
        gone.cast("long").alias("n_removed"),
        F.array_join(kept, " ").alias("kept_text"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` in ``substring_dedup``.

    ``kept_text`` has the words that stay, joined by one space. Texts of null have no
    words. Rows with one id are one document, so no text of theirs loses words to
    another one; rows without an id come after all others and lose nothing to each
    other. Repeated rows have equal results. The result has all columns of ``docs`` and
    a struct named ``substring_dedup`` (a column of that name is replaced). Without
    documents there are no rows.
    """
    docs = docs.drop("substring_dedup")
    rows = judged(docs)
    with _small_batches(docs.sparkSession):
        spans = repeats(docs, rows)
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    copies = rows.where("copy").select("doc_id", "mark", none.alias("spans"), F.lit(True).alias("copy"))
    both = copies.unionAll(spans.withColumn("copy", F.lit(False)))
    cuts = both.groupBy("doc_id", "mark").agg(F.max("spans").alias("spans"), F.max("copy").alias("copy"))
    cuts = stored(cuts, "cuts")

    doc, place = fresh(docs, "doc"), fresh(docs, "place")
    key = F.col("doc_id").cast("bigint"), F.xxhash64(whole(F.col("text")))
    # Only texts that lose words are moved to meet their spans.
    has_cut = _rows_filter(cuts)
    test = F.pandas_udf(lambda x: pd.Series(has_cut(x.to_numpy())), "boolean")
    packed = docs.select(
        F.struct(*docs.columns).alias(doc), key[0].alias("own_id"), key[1].alias("own_mark"), _place(*key).alias(place)
    ).withColumn("moves", test(place))

    trimmed = F.btrim(whole(F.col(f"{doc}.text")), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_mark") == F.col("mark"))
    moved = packed.where("moves").join(cuts, same, "left")
    stay = packed.where(~F.col("moves")).withColumn("copy", F.lit(False)).withColumn("spans", none)
    parts = [
        part.select(
            doc,
            let(words, lambda w: _done(w, F.coalesce("copy", F.lit(False)), F.col("spans"))).alias("substring_dedup"),
        )
        for part in (moved, stay)
    ]
    return parts[0].unionAll(parts[1]).select(f"{doc}.*", "substring_dedup")
