"""Training rows for the classifiers: a bounded sample of labelled ids, never those held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out of training: crc32 of its id as text is divisible by 5. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of all labels that may train: nulls are left out; an id with several counts once, as the greatest."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def sampling(labels: DataFrame, column: str, per_class: tuple[int, int]) -> tuple[float, float]:
    """How many labels of 0 and of 1 each row of ``training_sample`` stands for."""
    counts = {r.label: r["count"] for r in known_labels(labels, column).groupBy("label").count().where("label IN (0, 1)").collect()}
    return tuple(max(1.0, counts.get(k, 0) / per_class[k]) for k in (0, 1))


def training_sample(labels: DataFrame, column: str, per_class: tuple[int, int], seed: int) -> DataFrame:
    """(doc_id, label): at most ``per_class`` ids of label 0 and of label 1, those with the least hashes.

    The bound is the operator's documented parameter, so the result may be broadcast. Nulls are left out; an id with
    several labels counts once, as the greatest.
    """
    known = known_labels(labels, column)
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class[k]) for k in (0, 1)]
    return picked[0].union(picked[1])


def one_each(rows: DataFrame) -> DataFrame:
    """(doc_id, text, label): one of the ``rows`` of each id, that with the least hash of its text, so that ids that repeat
    do not widen the sample's bound."""
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))
