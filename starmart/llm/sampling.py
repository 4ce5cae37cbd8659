"""Bounded samples of labelled rows, to fit small models on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with one row per id; of several labels the largest counts.

    Rows without an id or with a label other than 0 and 1 are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def bounded(
    docs: DataFrame,
    candidates: DataFrame,
    rows: int | None = None,
    chars: int | None = None,
    per_label: bool = False,
) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` candidates and about ``chars`` characters.

    ``per_label`` gives each label its own share of ``chars``: an equal one, and what
    labels with less text leave open goes to the others. Without ``rows`` every
    candidate counts.
    Candidates are taken in the order of a hash of their id. One whose text does not
    fit in what is left of ``chars`` is passed over and costs its own place only. A
    label of which no text fits keeps its shortest one. Only ids, labels and lengths
    of at most ``rows`` candidates reach the driver; the broadcast sides have as many
    rows. Texts are whole; a text of null counts as empty. Of rows with one id, the
    one whose text is the first by code point counts.
    """
    spark = docs.sparkSession
    rank = F.xxhash64("doc_id")
    chosen = candidates.select("doc_id", "label", rank.alias("rank"))
    if rows is not None:
        chosen = chosen.orderBy("rank", "doc_id").limit(rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.length(text).alias("n"))
    sized = (
        slim.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label", "rank")
        .agg(F.max("n").alias("n"))
        .collect()
    )
    sized.sort(key=lambda r: (r["rank"], r["doc_id"]))
    kept = [(row["doc_id"], row["label"]) for row in _fitting(sized, chars, per_label)]
    types = f"doc_id bigint, label {candidates.schema['label'].dataType.simpleString()}"
    ids = spark.createDataFrame(kept, types)
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def _fitting(sized: list[Row], chars: int | None, per_label: bool) -> list[Row]:
    """The rows of (label, n) that fit in ``chars`` in turn, and one of each label at least."""
    if chars is None:
        return sized
    groups: dict[object, list[Row]] = {}
    for row in sized:
        groups.setdefault(row["label"], []).append(row)
    turns = sorted(groups.values(), key=lambda g: sum(r["n"] for r in g)) if per_label else [sized]
    kept = []
    for i, group in enumerate(turns):
        share = chars // (len(turns) - i)
        for row in group:
            if row["n"] <= share:
                share -= row["n"]
                chars -= row["n"]
                kept.append(row)
    known = {row["label"] for row in kept}
    shortest = [min(group, key=lambda r: r["n"]) for group in groups.values()]
    return kept + [row for row in shortest if row["label"] not in known]
