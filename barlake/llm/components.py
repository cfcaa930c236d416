"""Connected components of an edge table, in Spark, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (the larger ones, or the smaller ones and itself) move to its least neighbour.

    The least neighbour comes from a partially aggregated group and is joined back, so that a node with very many
    neighbours is never gathered in one task (the join's hot side can be split).
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    moved = joined.where("v > u").select("v", "m") if large else joined.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
    return moved.where("v <> m").select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); component is the least node reachable.

    Each round is written to the shared folder, the round before deleted. It ends when a round leaves the edges as they
    were: every node then hangs on the least node of its component. Empty edges give an empty table.
    """
    now = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        old, before = now, mark
        now = scratch.write(_star(_star(old, large=True), large=False))
        mark = _mark(now)
        scratch.free(old)
        if before == mark:
            break
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """A few numbers that tell whether the edges changed; the first is 0 if there are none."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)
