"""Data quality of bar tables: gaps, sanity, outliers, scores, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.sources.bars import PRICES, interval_minutes


def width_ms() -> Column:
    """Milliseconds of the row's interval."""
    unit = F.when(F.col("interval").endswith("m"), 1).when(F.col("interval").endswith("h"), 60).otherwise(1440)
    return F.expr("cast(substring(interval, 1, length(interval) - 1) as long)") * unit * 60_000


def gaps(bars: DataFrame) -> DataFrame:
    """(symbol, interval, from_time, to_time, minutes) wherever the next bar is later than the interval."""
    w = Window.partitionBy("symbol", "interval").orderBy("open_time")
    step = F.col("open_time") - F.lag("open_time").over(w)
    return bars.select("symbol", "interval", F.lag("open_time").over(w).alias("from_time"), F.col("open_time").alias("to_time"), (step / 60_000).cast("long").alias("minutes"), (step > width_ms()).alias("gap")).where("gap").drop("gap")


def report(bars: DataFrame, from_zero: bool = True) -> DataFrame:
    """One row per symbol and interval: rows, gaps, bad prices, negative volumes, outliers (closes that move by
    more than half), missing rows, score, label. ``from_zero``: a rise from 0 to anything is an outlier; else a close after 0
    has no move."""
    w = Window.partitionBy("symbol", "interval").orderBy("open_time")
    before = F.lag("close").over(w)
    move = F.when(before == 0, F.when(F.col("close") != 0, float("inf")) if from_zero else None).otherwise(F.abs(F.col("close") / before - 1))
    rows = bars.withColumns({"step_": F.col("open_time") - F.lag("open_time").over(w), "move_": move, "width_": width_ms()})
    bad = F.lit(False)
    for c in PRICES:
        bad = bad | (F.col(c) <= 0)
    out = rows.groupBy("symbol", "interval").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("step_") > F.col("width_")).alias("gap_count"), F.count_if(bad).alias("bad_prices"),
        F.count_if(F.col("volume") < 0).alias("negative_volumes"), F.count_if(F.col("move_") > 0.5).alias("outliers"), (F.floor((F.max("open_time") - F.min("open_time")) / F.first("width_")) + 1).alias("expected_rows"),
    )
    out = out.withColumn("missing_rows", F.greatest(F.lit(0), F.col("expected_rows") - F.col("row_count")))
    score = 100 - F.least(F.lit(40), 3 * F.col("gap_count")) - F.least(F.lit(20), 2 * (F.col("bad_prices") + F.col("negative_volumes"))) - F.least(F.lit(20), F.col("outliers")) - F.least(F.lit(20), F.col("missing_rows"))
    out = out.withColumn("quality_score", F.greatest(F.lit(0), score))
    q = F.col("quality_score")
    return out.withColumn("quality_label", F.when(q >= 90, "Excellent").when(q >= 70, "Good").when(q >= 50, "Fair").otherwise("Poor"))


def validate_all(bars: DataFrame, symbols: list[str], intervals: list[str]) -> DataFrame:
    """The report for every symbol and interval asked for; ``exists`` is false where there are no bars."""
    spark = bars.sparkSession
    wanted = spark.createDataFrame([(s, i) for s in symbols for i in intervals], "symbol string, interval string")
    return wanted.join(report(bars).withColumn("found_", F.lit(True)), ["symbol", "interval"], "left").withColumn("exists", F.coalesce("found_", F.lit(False))).drop("found_")


def suggestions(reports: DataFrame) -> DataFrame:
    """What to do about each report."""
    says = F.array_compact(F.array(
        F.when(F.col("gap_count") > 0, F.lit("re-download the days around the gaps")), F.when(F.col("bad_prices") > 0, F.lit("drop rows without positive prices")),
        F.when(F.col("outliers") > 0, F.lit("inspect bars that move over 50 %")), F.when(F.col("missing_rows") > 0, F.lit("fill or re-download missing bars")),
    ))
    return reports.select("symbol", "interval", F.array_join(says, "; ").alias("suggestion"))


def missing_pivot(reports: DataFrame, intervals: list[str]) -> DataFrame:
    """Missing rows of each symbol, a column per interval."""
    return reports.groupBy("symbol").pivot("interval", intervals).sum("missing_rows").fillna(0).select("symbol", *[F.col(f"`{i}`").alias(f"missing_{i}") for i in intervals])


def merge_score(reports: DataFrame) -> DataFrame:
    return reports.select("symbol", "interval", F.greatest(F.lit(0), 100 - 5 * F.col("gap_count")).alias("merge_score"))


def low_quality(reports: DataFrame, threshold: int = 70) -> DataFrame:
    """The intervals of each symbol that score below ``threshold``."""
    return reports.where(F.col("quality_score") < threshold).groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("interval")), ",").alias("intervals"))


def repair_plan(bars: DataFrame, threshold: int = 70, from_zero: bool = True) -> DataFrame:
    """(symbol, interval, date): the days to load again, those that gaps touch where the report scores below ``threshold``."""
    low = report(bars, from_zero).where(F.col("quality_score") < threshold).select("symbol", "interval")
    day = lambda c: F.to_date(F.timestamp_millis(c))
    return gaps(bars).join(low, ["symbol", "interval"], "left_semi").select("symbol", "interval", F.explode(F.sequence(day("from_time"), day("to_time"))).alias("date")).distinct()


def status(wanted: DataFrame, bars: DataFrame, start: int, end: int) -> DataFrame:
    """(symbol, status, n_bars) of each ``wanted`` symbol: ``missing`` without bars, ``empty_range`` with none from ``start``
    to ``end`` (ms, both included), else ``ok``. Symbols wanted twice come once; null is never there."""
    inside = F.count_if(F.col("open_time").between(start, end)).alias("n_bars")
    found = bars.groupBy("symbol").agg(inside)
    known = F.when(F.col("n_bars").isNull(), "missing").when(F.col("n_bars") == 0, "empty_range").otherwise("ok")
    return wanted.select("symbol").distinct().join(found, "symbol", "left").select("symbol", known.alias("status"), F.coalesce("n_bars", F.lit(0)).alias("n_bars"))


def iqr_filter(rows: DataFrame, column: str, by: str, factor: float = 1.5) -> DataFrame:
    """Rows whose value lies within the quartiles widened by ``factor`` times their distance, per ``by``."""
    bounds = rows.groupBy(by).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q_"))
    low, high = F.col("q_")[0], F.col("q_")[1]
    return rows.join(bounds, by).where((F.col(column) >= low - factor * (high - low)) & (F.col(column) <= high + factor * (high - low))).select(*rows.columns)


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from ``start`` to ``end``, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))


def missing_dates(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Days without a bar, per symbol."""
    days = bars.select("symbol", F.to_date(F.timestamp_millis("open_time")).alias("date")).distinct()
    wanted = bars.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return wanted.join(days, ["symbol", "date"], "left_anti")


def available(bars: DataFrame, intervals: list[str]) -> DataFrame:
    """Whether each symbol has every one of ``intervals``, and which it lacks."""
    lacks = F.array_except(F.array(*map(F.lit, intervals)), F.collect_set("interval"))
    return bars.groupBy("symbol").agg(F.array_join(F.array_sort(lacks), ",").alias("missing")).withColumn("available", F.col("missing") == "")


def top_symbols(tickers: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """The ``n`` listed symbols of the greatest volume, leveraged tokens left out; ties by name."""
    odd = ["UPUSDT", "DOWNUSDT", "BEARUSDT", "BULLUSDT"]
    keep = tickers
    for suffix in odd:
        keep = keep.where(~F.col("symbol").endswith(suffix))
    return keep.join(listed, "symbol", "left_semi").orderBy(F.desc("volume"), "symbol").limit(n)


def verify_checksums(files: DataFrame, sums: DataFrame) -> DataFrame:
    """``files`` (path, content) with ``valid``: sha256 as in ``sums`` (path, sha256); files without a sum are valid."""
    return files.join(sums.select("path", F.lower(F.trim("sha256")).alias("want_")), "path", "left").select("path", F.coalesce((F.sha2("content", 256) == F.col("want_")) | (F.col("want_") == ""), F.lit(True)).alias("valid"))
