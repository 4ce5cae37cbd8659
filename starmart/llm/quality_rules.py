"""Quality rules: a threshold table compiled into one projection.

The table names ratios of a text's counts and the span each must lie in. Counts,
ratios and verdict are built-in expressions over the text alone; nothing is
shuffled and no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.llm.common import BLANKS, let, whole, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for with was on as are be this by it from at or an "
    "der die und den das ist nicht von mit ein eine im zu des auf für "
    "le la les de des et en un une que qui dans pour est sur par du au "
    "el los las y del se una con por para su al como es"
)


@dataclass(frozen=True)
class Threshold:
    """``ratio`` must lie between ``least`` and ``most``, both included."""

    ratio: str
    least: float
    most: float


DEFAULT_TABLE = (
    Threshold("chars_per_word", 2.0, 20.0),
    Threshold("symbols_per_word", 0.0, 0.30),
    Threshold("stop_words_per_word", 0.03, 1.0),
    Threshold("dup_lines_per_line", 0.0, 0.50),
)

RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_words_per_word": ("n_stop_words", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
}


def _repeated(words_: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    The windows are sorted by their words, so equal ones are neighbours; the
    places of those are then walked in order, each adding what it newly covers.
    """

    def covered(grams: Column) -> Column:
        def same(gram: Column, at: Column) -> Column:
            return F.coalesce(F.get(grams, at)["g"] == gram["g"], F.lit(False))

        twice = F.filter(grams, lambda x, i: same(x, i - 1) | same(x, i + 1))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda done, p: F.struct(
                (p + 3).alias("end"),
                (done["n"] + p + 3 - F.greatest(p, done["end"])).alias("n"),
            ),
            lambda done: done["n"],
        )

    grams = F.transform(
        F.sequence(F.lit(0), F.size(words_) - 3),
        lambda i: F.struct(
            F.concat_ws(" ", F.get(words_, i), F.get(words_, i + 1), F.get(words_, i + 2)).alias("g"),
            i.alias("p"),
        ),
    )
    return F.when(F.size(words_) < 3, 0).otherwise(let(F.sort_array(grams), covered))


def counts(text: Column, stop_words: str = STOP_WORDS) -> Column:
    """Struct of a text's counts; a text of null counts as empty."""
    listed = stop_words.split()
    content = whole(text)

    def line_counts(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup")
        )

    lines = F.filter(F.split(content, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")

    def of(words_: Column) -> Column:
        line = let(lines, line_counts)
        stops = F.size(F.filter(words_, lambda w: F.lower(w).isin(listed)))
        return F.struct(
            F.size(words_).cast("long").alias("n_words"),
            F.length(F.array_join(words_, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(content, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            line.alias("lines"),
            _repeated(words_).cast("long").alias("n_repeat_words"),
            stops.cast("long").alias("n_stop_words"),
        )

    return let(words(text), of)


def verdict(counted: Column, table: tuple[Threshold, ...] = DEFAULT_TABLE) -> Column:
    """True if every ratio of the table lies in its span; a ratio of nothing passes."""
    of = {
        **{n: counted[n] for n in ("n_words", "word_chars", "n_symbols", "n_stop_words")},
        "n_lines": counted["lines"]["n"],
        "n_dup_lines": counted["lines"]["dup"],
    }

    def holds(rule: Threshold) -> Column:
        part, base = RATIOS[rule.ratio]
        return (of[base] == 0) | (
            (of[part] >= rule.least * of[base]) & (of[part] <= rule.most * of[base])
        )

    return reduce(lambda a, b: a & b, [holds(rule) for rule in table], F.lit(True))


def judge(
    docs: DataFrame, text: str = "text", table: tuple[Threshold, ...] = DEFAULT_TABLE
) -> DataFrame:
    """Counts and verdicts of every row, beside its ``doc_id``.

    Null and empty texts have counts of 0 and fail the base rule. Repeated rows
    get a row each. Other columns of ``docs`` are not read, so their names cannot
    clash; an id of null stays null. An empty table gives no rows.
    """
    counted = docs.select(F.col("doc_id"), counts(F.col(text)).alias("c"))
    c = F.col("c")
    failed = (c["n_words"] < LEAST_WORDS) | (
        100 * c["n_repeat_words"] > MOST_REPEATED_PERCENT * c["n_words"]
    )
    return counted.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["word_chars"].alias("word_chars"),
        c["n_symbols"].alias("n_symbols"),
        c["lines"]["dup"].cast("long").alias("n_dup_lines"),
        c["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & verdict(c, table)).alias("kept"),
        c["n_stop_words"].alias("n_stop_words"),
        c["lines"]["n"].cast("long").alias("n_lines"),
    )
