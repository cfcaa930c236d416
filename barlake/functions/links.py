"""Links from row to row: the first mark at or after a point, and what lies on a path of such links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .scratch import Written


def first_from(marks: DataFrame, asks: DataFrame, width: int) -> DataFrame:
    """Each distinct (symbol, at_) of ``asks`` with ``found_`` of the symbol's first of ``marks`` (symbol, at_, found_) whose
    ``at_`` is not below it, null if there is none.

    ``at_`` is cut into blocks of ``width``: inside one, a window from its end backwards; else the first mark of a later block,
    of which there is one row each. So a symbol is many tasks, and equal questions are put once. No nulls in ``at_``.
    """
    hit = F.struct("found_")
    both = marks.select("symbol", "at_", F.lit(1).alias("kind_"), hit.alias("hit_")).union(asks.select("symbol", "at_").distinct().select("symbol", "at_", F.lit(0), F.lit(None)))
    both = both.withColumn("block_", F.expr(f"at_ div {width}"))
    backwards = Window.partitionBy("symbol", "block_").orderBy(F.desc("at_"), F.desc("kind_")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near_", F.last("hit_", True).over(backwards)).where("kind_ = 0")
    later = Window.partitionBy("symbol").orderBy(F.desc("block_")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy("symbol", "block_").agg(F.min_by("hit_", F.when(F.col("kind_") == 1, F.col("at_"))).alias("first_"))
    firsts = firsts.select("symbol", "block_", F.last("first_", True).over(later).alias("later_"))
    return near.join(firsts, ["symbol", "block_"]).select("symbol", "at_", F.coalesce("near_", "later_")["found_"].alias("found_"))


def _counted(disk: Written, table: DataFrame) -> tuple[DataFrame, int]:
    """``table`` as written and read back, and how many of its links are left, counted by the same job."""
    seen = Observation()
    return disk.write(table.observe(seen, F.count("next").alias("links"))), seen.get.get("links", 0)


def along(nodes: DataFrame, start: float) -> DataFrame:
    """(symbol, id, value) of the nodes on the path from each symbol's least ``id``; ``value``: ``start`` times the factors of the
    nodes before. ``nodes``: (symbol, id, next, factor), one row an ``id``; ``next`` is a greater id or null at an end.

    Links are doubled: each turn, a node learns the node twice as far and the product up to it, and the nodes reached reach as
    many again. A path of n nodes takes log n turns of joins by (symbol, id), each between two written tables.
    """
    disk = Written(nodes.sparkSession, "along")
    heads = nodes.groupBy("symbol").agg(F.min("id").alias("head_"))
    table = nodes.join(heads, "symbol").select("symbol", "id", "next", F.col("factor").cast("double").alias("factor"), F.when(F.col("id") == F.col("head_"), F.lit(float(start))).alias("value"))
    table, left = _counted(disk, table)
    while left:
        far = table.where("next IS NOT NULL").select("symbol", F.col("id").alias("next"), F.col("next").alias("far_"), F.col("factor").alias("more_"))
        jumped = table.select("symbol", "id", "next", "factor", "value").join(far, ["symbol", "next"], "left").select("symbol", "id", F.col("far_").alias("next"), (F.col("factor") * F.col("more_")).alias("factor"), "value")
        reached = table.where("next IS NOT NULL AND value IS NOT NULL").select("symbol", F.col("next").alias("id"), (F.col("value") * F.col("factor")).alias("now_"))
        table, left = _counted(disk, jumped.join(reached, ["symbol", "id"], "left").select("symbol", "id", "next", "factor", F.coalesce("value", "now_").alias("value")))
        disk.drop(disk.count - 1)
    return table.where("value IS NOT NULL").select("symbol", "id", "value")
