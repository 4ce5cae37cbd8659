"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size is the number of copies that each of its
documents is expected to give. The whole part is taken for certain. For the
rest, documents are ranked by the odds of a random number divided by the odds of
their inclusion, and the first ones make up a sample of fixed size. Size is
counted in words, because that is what targets are stated in: the sample ends
where the words that the whole copies left open are used up. The document that
crosses that point is taken if the sample then ends nearer to it than before it.

No window holds a source. Ranks are cut into buckets, sums per bucket find the
one in which the sample ends, and only that bucket is ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starmart.llm.common import stored, whole, word_count

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BUCKETS = 4096
PASSES = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum
    of all sizes. A target above ``most`` times its source's size stops there and
    the excess goes to the others by weight. With sources in the order of
    (limit / weight) the stopped ones come first; the common factor of the others
    is the first that its own source can take. One row per source is ranked.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = per_source.withColumn("n", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(onward)
    fits = F.col("limit") >= F.col("factor") * F.col("weight")
    first_fit = F.min(F.when(fits, F.struct("place", "factor"))).over(everything)
    return (
        limited.withColumn("factor", left / weight_left)
        .withColumn("place", F.row_number().over(order))
        .withColumn("common", first_fit["factor"])
        .select(
            "source",
            "source_size",
            F.least(F.col("limit").cast("double"), F.col("common") * F.col("weight")).alias("target"),
        )
    )


def _uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1, both excluded, that depends on the row and the seed."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(2**53))


def _cuts(left: DataFrame, nearest: bool) -> DataFrame:
    """What a pass takes of each group: (cut_group, cut_most, cut_bucket, from, last, more).

    ``left`` has the rows that may still be taken: group, gap, bucket, place, size.
    Rows longer than ``cut_most`` are passed over; equal rows go together. The prefix
    of the others that stays inside the gap holds whole buckets before ``cut_bucket``
    and, in that one, rows up to ``last``. ``more`` is what then remains of the gap.
    With ``nearest`` only the row that crosses the gap is taken, and only if the sum
    up to it is nearer the gap than the prefix; ``from`` and ``last`` are its place,
    and groups without one are left out. A row longer than twice the gap never
    brings it nearer.
    """
    group = Window.partitionBy("group")
    most = (2 if nearest else 1) * F.col("gap")
    fitting = left.where((F.col("size") > 0) & (F.col("size") <= most))
    sums = (
        fitting.groupBy("group", "bucket")
        .agg(F.sum("size").alias("words"), F.first("gap").alias("gap"), F.first(most).alias("most"))
        .withColumn("sum", F.sum("words").over(group.orderBy("bucket")))
    )
    over = F.col("sum") > F.col("gap")
    ends = stored(
        sums.groupBy("group").agg(
            F.first("gap").alias("gap"),
            F.first("most").alias("cut_most"),
            F.min(F.when(over, F.col("bucket"))).alias("cut_bucket"),
            F.coalesce(F.max(F.when(~over, F.col("sum"))), F.lit(0)).alias("before"),
        ).withColumnsRenamed({"group": "cut_group", "gap": "cut_gap"}),
        "cut-bucket",
    )
    same_group = F.col("group").eqNullSafe(F.col("cut_group"))
    tied = (
        fitting.join(ends, same_group & (F.col("bucket") == F.col("cut_bucket")))
        .groupBy("group", "place")
        .agg(F.sum("size").alias("words"), F.first("cut_gap").alias("gap"), F.first("before").alias("before"))
        .withColumn("sum", F.col("before") + F.sum("words").over(group.orderBy("place")))
    )
    last = tied.groupBy(F.col("group").alias("last_group")).agg(
        F.max(F.when(~over, F.col("place"))).alias("last"),
        F.max(F.when(~over, F.col("sum"))).alias("filled"),
        F.min(F.when(over, F.struct("place", "sum", "words"))).alias("next"),
    )
    joined = ends.join(last, F.col("cut_group").eqNullSafe(F.col("last_group")), "left")
    kept = joined.withColumn("kept", F.coalesce("filled", "before"))
    if nearest:
        kept = kept.where(F.col("next.sum") - F.col("cut_gap") < F.col("cut_gap") - F.col("kept"))
        kept = kept.withColumn("last", F.col("next.place")).withColumn("kept", F.col("next.words"))
    first = F.col("last") if nearest else F.lit(None).cast(kept.schema["last"].dataType)
    more = F.col("cut_gap") - F.col("kept")
    return stored(
        kept.select(
            "cut_group", "cut_most", "cut_bucket", first.alias("from"), "last", more.alias("more")
        ),
        "cut",
    )


def pareto_sample(
    rows: DataFrame,
    seed: int = 0,
    buckets: int = BUCKETS,
    passes: int = PASSES,
    full: DataFrame | None = None,
) -> DataFrame:
    """``rows`` with ``copies``: how often the mix takes each.

    ``full`` may be the same rows with more columns; the result is then made of it.
    ``rows`` has group, doc_id, key, size and ``expected`` copies (0 or more, may
    differ inside a group). The fractional parts of ``expected`` are the inclusion
    probabilities; the sample of a group has the size that is the sum of
    (probability x size). The document of the Pareto order that crosses that sum is
    taken first if the prefix with it ends nearer the sum than without it, so one
    longer than the sum can be taken too. The rest of the sample is the prefix that
    fits what is then open; further passes go on down the order with documents that
    fit, and at the end one more that crosses the sum if that is nearer. Rows equal
    in all of (key, doc_id, size) are taken or left together. Rows of size 0 get
    their whole copies only.
    """
    part = F.col("expected") - F.floor("expected")
    u = _uniform(F.col("key"), seed)
    odds = F.when(F.col("part") > 0, (u / (1 - u)) * (1 - F.col("part")) / F.col("part"))
    ranked = (
        rows.withColumn("part", part)
        .where(F.col("part") > 0)
        .withColumn("q", odds)
        .withColumn("bucket", F.floor(F.lit(buckets) * F.col("q") / (1 + F.col("q"))))
        .select("group", "doc_id", "key", "size", "part", "bucket", _place().alias("place"))
    )
    # Decimals add up to the same sum in any order.
    gap = F.sum((F.col("part") * F.col("size")).cast("decimal(38,9)")).cast("double").alias("gap")
    gaps = stored(ranked.groupBy(F.col("group").alias("gap_group")).agg(gap), "gaps")
    left = ranked.join(gaps, F.col("group").eqNullSafe(F.col("gap_group"))).drop("gap_group")
    left = stored(left, "left")
    ends = None
    for i, nearest in enumerate((True, *[False] * passes, True)):
        cuts = _cuts(left, nearest)
        numbered = cuts.withColumn("number", F.lit(i))
        ends = numbered if ends is None else ends.unionAll(numbered)
        if i > passes:
            break
        same = F.col("group").eqNullSafe(F.col("cut_group"))
        inside = F.coalesce(_inside(F.struct(*cuts.columns)), F.lit(False))
        left = left.join(cuts, same, "left").where(~inside).withColumn("gap", F.coalesce("more", "gap"))
        left = stored(left.select(*ranked.columns, "gap"), "left")

    # One row per group with the cuts of all passes; a row taken by one of them is taken.
    cuts = stored(
        ends.groupBy("cut_group").agg(
            F.collect_list(F.struct("cut_most", "cut_bucket", "from", "last")).alias("cuts")
        ),
        "cuts",
    )
    full = rows if full is None else full
    placed = (
        full.withColumn("part", part)
        .withColumn("q", odds)
        .withColumn("bucket", F.floor(F.lit(buckets) * F.col("q") / (1 + F.col("q"))))
        .withColumn("place", _place())
        .join(cuts, F.col("group").eqNullSafe(F.col("cut_group")), "left")
    )
    taken = F.coalesce(F.exists("cuts", _inside), F.lit(False)) & (F.col("part") > 0)
    copies = F.floor("expected") + taken.cast("long")
    return placed.withColumn("copies", copies).select(*full.columns, "copies")


def _place() -> Column:
    return F.struct("q", "key", "doc_id", "size")


def _inside(cut: Column) -> Column:
    """Whether a cut takes a row."""
    before = cut["cut_bucket"].isNull() | (F.col("bucket") < cut["cut_bucket"])
    up_to = (F.col("bucket") == cut["cut_bucket"]) & (F.col("place") <= cut["last"])
    since = cut["from"].isNull() | (F.col("place") >= cut["from"])
    fits = (F.col("size") > 0) & (F.col("size") <= cut["cut_most"])
    return F.coalesce(fits & since & (before | F.coalesce(up_to, F.lit(False))), F.lit(False))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 0,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Every row of ``docs`` with a struct ``mixing``: how the mix takes it.

    The struct has size, source_size, target, copies and taken (words, repeats
    counted); a column of that name is replaced. Null texts have a size of 0, as
    have texts without words. A source of null is a source of its own. Equal rows
    get equal results, reruns too, since the random number comes from id and text.
    Without documents there are no rows.
    """
    docs = docs.drop("mixing")
    key = F.xxhash64("doc_id", whole(F.col("text"))).alias("key")
    own = [F.col("doc_id"), key, F.col("source"), word_count(F.col("text")).alias("size")]
    slim = stored(docs.select(*own), "sizes")
    aims = stored(targets(slim, weights, most), "targets").withColumnRenamed("source", "of")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def aimed(rows: DataFrame) -> DataFrame:
        joined = rows.join(aims, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        return joined.withColumn("group", F.col("source")).withColumn("expected", expected)

    full = aimed(docs.select(F.struct(*docs.columns).alias("doc"), *own))
    sampled = pareto_sample(aimed(slim), seed, buckets, full=full)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    mixing = F.struct("size", "source_size", "target", "copies", taken).alias("mixing")
    return sampled.select("doc", mixing).select("doc.*", "mixing")


def repeated(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the same columns."""
    mixed = mix(docs, **options)
    each = F.explode(F.sequence(F.lit(1), F.col("mixing.copies").cast("int")))
    taken = mixed.where(F.col("mixing.copies") > 0)
    return taken.select(F.struct(*docs.columns).alias("doc"), each.alias("copy")).select("doc.*")
