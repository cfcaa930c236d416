"""Backward as-of joins of bar tables, by union and window: one shuffle, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.sources.bars import interval_minutes


def asof(left: DataFrame, right: DataFrame, key: str = "symbol", left_on: str = "open_time", right_on: str = "open_time") -> DataFrame:
    """``left`` with the columns of the last ``right`` row of the key at or before its time; nulls if there is none.

    Equal times match. Rows of a clashing name keep the left's.
    """
    own = [c for c in right.columns if c not in left.columns]
    a = left.select(F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(F.struct(*own).alias("r")).schema["r"].dataType).alias("r"), F.col(key).alias("key_"), F.col(left_on).alias("at_"), F.lit(1).alias("side_"))
    b = right.select(F.lit(None).cast(a.schema["l"].dataType).alias("l"), F.struct(*own).alias("r"), F.col(key).alias("key_"), F.col(right_on).alias("at_"), F.lit(0).alias("side_"))
    w = Window.partitionBy("key_").orderBy("at_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn("r", F.last("r", ignorenulls=True).over(w)).where("side_ = 1").select("l.*", "r.*")


def grid_matches(keys: DataFrame, right: DataFrame, step: int, fan: int = 32, levels: int = 4) -> DataFrame:
    """``keys`` (symbol, open_time) with the other columns of the last ``right`` row of the symbol at or before the time, for
    right rows that lie on a grid of ``step`` ms (at most one a cell, as bars do). Keys without such a row are left out.

    A row's own cell is an equi-join, which is all for most rows. Rows whose cell is empty look back by levels, in one more
    equi-join: at the cells of the same block of ``fan`` cells, at the last rows of the blocks of the same larger block, and so
    on, at most ``fan`` rows a level; the last level has no bound, so that nothing is lost. No window, so a symbol is as
    many tasks as it has cells.
    """
    cell = lambda k: F.floor(F.col("open_time") / (step * fan**k)).cast("long")
    over = lambda k: cell(k) if k < levels else F.lit(0).cast("long")
    asked = keys.select("symbol", "open_time").distinct().withColumn("cell_", cell(0))
    now = asked.join(right.select("symbol", F.col("open_time").alias("at_"), cell(0).alias("cell_")), ["symbol", "cell_"], "left")
    inside = F.coalesce(F.col("at_") <= F.col("open_time"), F.lit(False))
    each = lambda: F.array(*[F.struct(F.lit(k).alias("level_"), over(k).alias("over_"), cell(k - 1).alias("own_")) for k in range(1, levels + 1)])
    rest = now.where(~inside).select("symbol", "open_time", F.inline(each()))
    last = right.select("symbol", "open_time", F.inline(each())).groupBy("symbol", "level_", "over_", F.col("own_").alias("c_")).agg(F.max("open_time").alias("at_"))
    back = rest.join(last, ["symbol", "level_", "over_"]).where("c_ < own_").groupBy("symbol", "open_time").agg(F.max("at_").alias("at_"))
    found = now.where(inside).select("symbol", "open_time", "at_").unionByName(back)
    return found.join(right.withColumnRenamed("open_time", "at_"), ["symbol", "at_"]).drop("at_")


def asof_grid(left: DataFrame, right: DataFrame, step: int) -> DataFrame:
    """As ``asof`` by symbol and open_time, for right rows on a grid of ``step`` ms; see ``grid_matches``."""
    own = [c for c in right.columns if c not in left.columns]
    return left.join(grid_matches(left, right.select("symbol", "open_time", *own), step), ["symbol", "open_time"], "left").select(*left.columns, *own)


def align_grid(frames: dict[str, DataFrame], base: str = "15m") -> DataFrame:
    """``align`` of bars on their grids, by equi-joins."""
    out = prefixed(frames[base], base)
    for name, bars in frames.items():
        if name != base:
            out = out.join(grid_matches(frames[base], prefixed(bars, name), interval_minutes(name) * 60_000), ["symbol", "open_time"], "left")
    return out


def prefixed(bars: DataFrame, interval: str) -> DataFrame:
    """Columns renamed to ``{interval}_{name}``, but for symbol and open_time."""
    return bars.select("symbol", "open_time", *[F.col(f"`{c}`").alias(f"{interval}_{c}") for c in bars.columns if c not in ("symbol", "open_time", "interval")])


def align(frames: dict[str, DataFrame], base: str = "15m", closed_only: bool = False) -> DataFrame:
    """All intervals on the base interval's rows. ``closed_only``: a longer bar is seen once it has ended, else from its start."""
    out = prefixed(frames[base], base)
    step = interval_minutes(base) * 60_000
    for name, bars in frames.items():
        if name != base:
            side = prefixed(bars, name)
            if closed_only:
                side = side.withColumn("open_time", F.col("open_time") + interval_minutes(name) * 60_000 - step)
            out = asof(out, side)
    return out
