"""Ordered windows per symbol, rolling aggregates with a minimum of rows, and exponential averages as blocked scans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time")


def back(n: int, end: int = 0) -> WindowSpec:
    """The last ``n`` rows up to ``end`` (0: this row, -1: the one before)."""
    return by_time().rowsBetween(end + 1 - n, end)


def so_far() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg: Column, x: Column, n: int, least: int, end: int = 0) -> Column:
    """``agg`` over ``n`` rows; null with fewer than ``least`` values of ``x``."""
    w = back(n, end)
    return F.when(F.count(x).over(w) >= least, agg.over(w))


def among(mark: str) -> WindowSpec:
    """The symbol's rows that are alike in ``mark``, by time: for the marked ones, those marked before. Rows that are dealt
    by symbol need no other exchange for it."""
    return Window.partitionBy("symbol", mark).orderBy("open_time")


def flag(condition: Column) -> Column:
    """1 or 0; a condition that is null counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("tinyint")


def last_where(condition: Column, x: Column) -> Column:
    """``x`` of the last row so far at which ``condition`` held."""
    return F.last(F.when(condition, x), ignorenulls=True).over(so_far())


def block_size(alpha: float) -> int:
    """Rows of a block for which (1 - alpha) ** -rows stays far from overflow."""
    return 256 if alpha >= 1 else max(8, min(256, int(600 / -math.log(1 - alpha))))


def ewm(bars: DataFrame, averages: dict[str, tuple[str, float, int]]) -> DataFrame:
    """``bars`` with exponential averages: {new column: (input column, alpha, least values)}.

    y = (1 - alpha) * y before + alpha * x, starting with the first value; null before ``least`` values. Inputs may start
    with nulls but have none in between. Rows are numbered per symbol and cut into blocks: a windowed sum makes each
    block's own part, to which the ends of the blocks before are added, as far as they weigh more than 2 ** -60. All windows
    are by symbol, so that bars are shuffled once and nothing is joined.
    """
    size = min(block_size(a) for _, a, _ in averages.values())
    base = bars.withColumn("rn_", F.row_number().over(by_time()) - 1).withColumns({f"n_{y}": F.count(x).over(so_far()) for y, (x, _, _) in averages.items()})
    base = base.withColumns({"block_": F.floor(F.col("rn_") / size).cast("int"), "k_": (F.col("rn_") % size).cast("int")})
    inside = Window.partitionBy("symbol", "block_").orderBy("rn_").rowsBetween(Window.unboundedPreceding, 0)
    in_order = Window.partitionBy("symbol").orderBy("rn_")
    parts, ends, carried = {}, {}, {}
    for y, (x, a, _) in averages.items():
        weight = F.when(F.col(x).isNull(), 0.0).when(F.col(f"n_{y}") == 1, 1.0).otherwise(a)
        q = F.lit(1 - a)
        parts[f"p_{y}"] = F.pow(q, F.col("k_")) * F.sum(weight * F.coalesce(F.col(x).cast("double"), F.lit(0.0)) * F.pow(q, -F.col("k_"))).over(inside)
        ends[f"e_{y}"] = F.last(F.when(F.col("k_") == size - 1, F.col(f"p_{y}")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        decay = (1 - a) ** size
        terms = 1 if decay < 2.0**-60 else math.ceil(60 * math.log(2) / -math.log(decay))
        carried[f"c_{y}"] = sum((decay**j * F.coalesce(F.lag(f"e_{y}", j * size).over(in_order) if j else F.col(f"e_{y}"), F.lit(0.0)) for j in range(terms)), F.lit(0.0))
    out = base.withColumns(parts).withColumns(ends).withColumns(carried)
    made = {y: F.when(F.col(f"n_{y}") >= max(1, least), F.col(f"p_{y}") + F.col(f"c_{y}") * F.pow(F.lit(1 - a), F.col("k_") + 1)) for y, (_, a, least) in averages.items()}
    return out.withColumns(made).select(*bars.columns, *averages)
