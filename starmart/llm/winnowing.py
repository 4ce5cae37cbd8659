"""Document fingerprints by winnowing, with built-in functions alone.

A text's words are hashed, and so is every run of ``k`` of them. In each window
of ``w`` such hashes the smallest is selected, the rightmost of equal ones; a
selection that stays is recorded once, with its position. Two texts that share
``k + w - 1`` words in a row therefore share a selected hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm.common import let, whole, words

GRAM = 5
WINDOW = 8
ROWS_PER_BUCKET = 200
MOST_BUCKETS = 10_000


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Array of (hash, back): selected hashes and their negated positions, in order.

    Fewer than ``gram`` words are one gram, fewer grams than ``window`` one window;
    a text without words has none.
    """

    def grams(hashes: Column) -> Column:
        n = F.size(hashes)
        places = F.sequence(F.lit(0), n - gram)
        run = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(gram)])
        short = F.array(F.struct(F.xxhash64(hashes).alias("hash"), F.lit(0).alias("back")))
        many = F.transform(places, lambda i: F.struct(run(i).alias("hash"), (-i).alias("back")))
        return F.when(n == 0, F.slice(short, 1, 0)).when(n < gram, short).otherwise(many)

    def selected(found: Column) -> Column:
        n = F.size(found)
        starts = F.sequence(F.lit(1), n - window + 1)
        least = F.transform(starts, lambda j: F.array_min(F.slice(found, j, window)))
        new = lambda mins: F.filter(
            mins,
            lambda x, i: F.coalesce(F.get(mins, i - 1)["back"] != x["back"], F.lit(True)),
        )
        return (
            F.when(n == 0, found)
            .when(n <= window, F.array(F.array_min(found)))
            .otherwise(let(least, new))
        )

    hashed = F.transform(words(text), lambda word: F.xxhash64(word))
    return let(let(hashed, grams), selected)


def hashes(prints: Column) -> Column:
    return F.transform(prints, lambda x: x["hash"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def digest(prints: Column) -> Column:
    """SHA-256 over the selected hashes and positions."""
    parts = F.transform(prints, lambda x: F.concat_ws(":", -x["back"], F.hex(x["hash"])))
    return F.sha2(F.array_join(parts, " "), 256)


def _order(doc_id: str, row: str) -> list[Column]:
    return [F.col(doc_id).desc_nulls_last(), F.col(row)]


def with_next(docs: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows of (doc_id, text, next) in descending order of doc_id, last to first.

    ``extra`` names expressions over ``text`` that are computed once per document;
    ``next`` is a struct of the next document's text and extras. Rows with one id
    follow each other in the order of their texts' hashes, rows without an id come
    last. Nulls are empty texts. A single document follows itself.

    Ids are cut at quantiles into buckets of about ``ROWS_PER_BUCKET`` rows, so no
    window holds more; the last row of a bucket gets the first of the following
    one. Of those, ids and hashes only reach the driver, one row per bucket.
    """
    spark, extra = docs.sparkSession, extra or {}
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")
    )
    count = docs.count()
    buckets = max(1, min(MOST_BUCKETS, math.ceil(count / ROWS_PER_BUCKET)))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = slim.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] or []
    bounds = sorted(set(cuts))
    listed = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    above = F.size(F.filter(listed, lambda bound: bound >= F.col("doc_id")))
    bucket = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(above)
    keyed = slim.withColumn("bucket", bucket).withColumn("row", F.xxhash64("text"))

    first = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), "row")
    heads = keyed.groupBy("bucket").agg(F.min(first).alias("head")).collect()
    heads.sort(key=lambda h: h["bucket"])
    following = [
        (here["bucket"], None if there["head"]["none"] else -there["head"]["down"], there["head"]["row"])
        for here, there in zip(heads, heads[1:] + heads[:1], strict=True)
    ]
    wanted = spark.createDataFrame(following, "of int, head_id bigint, head_row bigint")
    parts = F.struct(F.col("text"), *[e.alias(n) for n, e in extra.items()])
    head_texts = (
        keyed.join(
            F.broadcast(wanted),
            F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("row") == F.col("head_row")),
        )
        .groupBy("of")
        .agg(F.first("text").alias("text"))
        .select(F.col("of"), parts.alias("head"))
    )
    order = Window.partitionBy("bucket").orderBy(*_order("doc_id", "row"))
    led = (
        keyed.repartition("bucket")
        .withColumns(extra)
        .withColumn("following", F.lead(F.struct("text", *extra)).over(order))
    )
    return led.join(head_texts, F.col("bucket") == F.col("of"), "left").select(
        "doc_id", "text", *extra, F.coalesce("following", "head").alias("next")
    )


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third replaced by as many first characters of the other."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def compare(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Returns doc_id, n_chars, edited_text, prints, edited_prints (arrays), near_edited
    and near_next. Rules for nulls, ties and repeated rows are those of ``with_next``;
    other columns of ``docs`` are not read. Without documents there are no rows.
    """
    prints = {"prints": fingerprint(F.col("text"), gram, window)}
    paired = with_next(docs, prints).withColumn(
        "edited_text", edited(F.col("text"), F.col("next.text"))
    )
    printed = paired.withColumn("edited_prints", fingerprint(F.col("edited_text"), gram, window))
    own, other = hashes(F.col("prints")), hashes(F.col("edited_prints"))
    return printed.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "edited_text",
        "prints",
        "edited_prints",
        likeness(own, other).alias("near_edited"),
        likeness(own, hashes(F.col("next.prints"))).alias("near_next"),
    )
