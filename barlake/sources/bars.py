"""Bars: schemas, readers and writers. A bar table has symbol, interval, open_time (ms) and open, high, low, close, volume."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KLINE_SCHEMA = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_asset_volume double, number_of_trades long, taker_buy_base_asset_volume double, taker_buy_quote_asset_volume double, ignore double"
PRICES = ["open", "high", "low", "close"]
#: Minutes of each unit letter.
UNITS = {"m": 1, "h": 60, "d": 1440}


def interval_minutes(interval: str) -> int:
    """Minutes of an interval such as 15m, 1h, 4h, 1d; other forms raise ValueError."""
    number, unit = interval[:-1], interval[-1:].lower()
    if unit not in UNITS or not number.isdigit() or not int(number):
        raise ValueError(f"unknown interval: {interval!r}")
    return int(number) * UNITS[unit]


def canonical_interval(label: str) -> str:
    """15m for M15, 1h for H1 and so on; canonical labels pass through."""
    label = label.strip()
    if label[:1].upper() in ("M", "H", "D") and label[1:].isdigit():
        label = label[1:] + label[0].lower()
    interval_minutes(label)
    return label.lower()


def whole(x: Column, by: int) -> Column:
    """Integer division of longs, without the detour over doubles."""
    return ((x - x % by).cast("decimal(20,0)") / by).cast("long")


def epoch_ms(x: Column) -> Column:
    """Milliseconds from an epoch value in seconds, ms, us or ns, told apart by its magnitude row by row."""
    return F.when(x >= 10**17, whole(x, 1_000_000)).when(x >= 10**14, whole(x, 1000)).when(x < 10**11, x * 1000).otherwise(x).cast("long")


def read_kline_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless kline files (plain or gz) with the file they come from; symbol and interval are read from its path."""
    raw = spark.read.schema(KLINE_SCHEMA).option("header", False).csv(path).withColumn("file", F.col("_metadata.file_path"))
    at = r"([A-Z0-9]+)[-/](\d+[mhd])[-/][^/]*$"
    return raw.withColumns({"symbol": F.regexp_extract("file", at, 1), "interval": F.regexp_extract("file", at, 2), "open_time": epoch_ms(F.col("open_time"))})


def keep_last(bars: DataFrame, order: list[Column], keys: tuple[str, ...] = ("symbol", "interval", "open_time")) -> DataFrame:
    """One row for each key: the last by ``order``. A partially aggregated group, so a hot key stays one row a task."""
    rest = [c for c in bars.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return bars.groupBy(*keys).agg(last).select(*keys, "last.*").select(*bars.columns)


def upsert(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Bars of both tables; where both have a key, the new one's. Of repeats within one table the last by ``order`` stays (a
    column of both that tells which row is later, such as a load number); without it that of the greatest close."""
    both = old.withColumn("prio", F.lit(0)).unionByName(new.withColumn("prio", F.lit(1)))
    return keep_last(both, [F.col("prio"), *([F.col(order)] if order else []), F.col("close")]).drop("prio")


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by interval and symbol, so that scans of a symbol read its files only."""
    bars.write.mode(mode).partitionBy("interval", "symbol").parquet(path)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, intervals: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Bars of symbols and intervals with open_time from ``start`` to ``end``, both inclusive."""
    out = spark.read.parquet(path)
    if symbols:
        out = out.where(F.col("symbol").isin(symbols))
    if intervals:
        out = out.where(F.col("interval").isin([canonical_interval(i) for i in intervals]))
    if start is not None:
        out = out.where(F.col("open_time") >= start)
    return out if end is None else out.where(F.col("open_time") <= end)


def metadata(bars: DataFrame) -> DataFrame:
    """Rows, first and last open_time of each symbol and interval."""
    return bars.groupBy("symbol", "interval").agg(F.count("*").alias("row_count"), F.min("open_time").alias("start_time"), F.max("open_time").alias("end_time"))


def bars_of(ticks: DataFrame, interval: str) -> DataFrame:
    """Bars from ticks (symbol, time_us, seq, price, size): open and close by (time_us, seq); empty buckets give no bar."""
    width = interval_minutes(interval) * 60_000
    bucket = (F.floor(F.col("time_us") / (width * 1000)) * width).cast("long").alias("open_time")
    at = F.struct("time_us", "seq")
    return (
        ticks.groupBy("symbol", bucket)
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
        .select("symbol", F.lit(interval).alias("interval"), "open_time", "open", "high", "low", "close", "volume")
    )


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Longer bars from shorter ones; empty buckets give no bar."""
    width = interval_minutes(interval) * 60_000
    bucket = (F.col("open_time") - F.pmod("open_time", F.lit(width))).cast("long").alias("bucket")
    return (
        bars.groupBy("symbol", bucket)
        .agg(F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.lit(interval).alias("interval"), F.col("bucket").alias("open_time"), "open", "high", "low", "close", "volume")
    )


def enrich(bars: DataFrame, window: int = 20) -> DataFrame:
    """date, daily_return (change of close), price_range and volume_ma (mean of up to ``window`` bars)."""
    w = Window.partitionBy("symbol", "interval").orderBy("open_time")
    return bars.withColumns({
        "date": F.to_date(F.timestamp_millis("open_time")),
        "daily_return": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1,
        "price_range": F.try_divide(F.col("high") - F.col("low"), F.col("open")),
        "volume_ma": F.avg("volume").over(w.rowsBetween(1 - window, 0)),
    })


def ticks_of_events(events: DataFrame) -> DataFrame:
    """The event table as ticks: event types are symbols, each event has size 1."""
    return events.select(F.col("event_type").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def latest(bars: DataFrame, rows: int) -> DataFrame:
    """The last ``rows`` bars of each symbol and interval: a bounded history."""
    w = Window.partitionBy("symbol", "interval").orderBy(F.desc("open_time"))
    return bars.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= rows).drop("n_")


def refresh(old: DataFrame, new: DataFrame, rows: int, order: str | None = None) -> DataFrame:
    """``old`` bars with the ``new`` ones, which win where both have a key, cut to the last ``rows`` of each symbol and interval."""
    return latest(upsert(old, new, order), rows)


def backfill(bars: DataFrame, least: int) -> DataFrame:
    """(symbol, interval, start, end): what to load before the first bar of each symbol and interval with fewer than ``least``
    rows, in ms, both included, so that it has ``least`` if none is missing."""
    found = bars.groupBy("symbol", "interval").agg(F.count("*").alias("n_"), F.min("open_time").alias("first_"))
    unit = F.when(F.col("interval").endswith("m"), 1).when(F.col("interval").endswith("h"), 60).otherwise(1440)
    width = F.regexp_extract("interval", r"^(\d+)", 1).cast("long") * unit * 60_000
    return found.where(F.col("n_") < least).select("symbol", "interval", (F.col("first_") - (least - F.col("n_")) * width).alias("start"), (F.col("first_") - 1).alias("end"))


def year_chunks(bars: DataFrame, warmup_days: int = 60) -> DataFrame:
    """For each symbol and calendar year (UTC) of its bars: where entries start and end, and where loading starts for them."""
    day = 86_400_000
    span = bars.groupBy("symbol").agg(F.min("open_time").alias("first_"), F.max("open_time").alias("last_"))
    of = lambda c: F.year(F.timestamp_millis(c))
    each = span.withColumn("year", F.explode(F.sequence(of("first_"), of("last_"))))
    start = F.unix_millis(F.make_timestamp("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    end = F.unix_millis(F.make_timestamp(F.col("year") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) - 1
    entry = F.greatest("first_", start)
    return each.select("symbol", F.col("year").cast("long").alias("year"), F.greatest("first_", entry - warmup_days * day).alias("load_start_ms"), F.least("last_", end).alias("load_end_ms"), entry.alias("entry_start_ms"), F.least("last_", end).alias("entry_end_ms"))


def day_range(start: str, end: str) -> tuple[int, int]:
    """(first, last) millisecond of the days from ``start`` to ``end`` (YYYY-MM-DD, UTC), both included."""
    first, last = (datetime.datetime.strptime(d, "%Y-%m-%d").replace(tzinfo=datetime.UTC) for d in (start, end))
    return int(first.timestamp() * 1000), int(last.timestamp() * 1000) + 86_400_000 - 1


def read_klines_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars from files of one JSON array of kline arrays each, as exchanges answer; symbol and interval are read from the path."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("k"), F.col("_metadata.file_path").alias("file"))
    at = r"([A-Z0-9]+)[-_/](\d+[mhd])[^/]*$"
    names = ["open", "high", "low", "close", "volume"]
    return raw.where(F.size("k") >= 6).select(F.regexp_extract("file", at, 1).alias("symbol"), F.regexp_extract("file", at, 2).alias("interval"), epoch_ms(F.element_at("k", 1).cast("long")).alias("open_time"), *[F.element_at("k", i + 2).cast("double").alias(n) for i, n in enumerate(names)])


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file): the names of all files of a path, empty ones too, which scans leave out. They are listed for a scan anyway."""
    return spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string").select(_one_form("file").alias("file"))


def _one_form(file: str) -> Column:
    """A file's name with one slash after ``file:``, as the two ways to get it differ there."""
    return F.regexp_replace(file, "^file:/+", "file:/")


def misshapen(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, bad_lines) of kline CSV files that are no klines: with lines of fewer than 6 fields or no number first, or
    without any line; none: all are good."""
    lines = spark.read.text(path).select(_one_form("_metadata.file_path").alias("file"), F.split("value", ",").alias("f"))
    bad = (F.size("f") < 6) | ~F.element_at("f", 1).rlike("^[0-9]+$")
    found = lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(bad).alias("bad_lines"))
    files = _files(spark, path)
    each = files.join(found, "file", "left").select("file", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("bad_lines", F.lit(0)).alias("bad_lines"))
    return each.where("bad_lines > 0 OR lines = 0")


def extraction_report(spark: SparkSession, path: str) -> DataFrame:
    """One row over the kline CSV files of a folder: how many are good, how many are not, and the rows of the good ones."""
    bad = misshapen(spark, path).select("file", F.lit(True).alias("bad_"))
    rows = spark.read.text(path).groupBy(_one_form("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_"))
    files = _files(spark, path)
    each = files.join(bad, "file", "left").join(rows, "file", "left")
    return each.agg(F.count_if(F.col("bad_").isNull()).alias("succeeded"), F.count_if(F.col("bad_").isNotNull()).alias("failed"), F.coalesce(F.sum(F.when(F.col("bad_").isNull(), F.col("n_"))), F.lit(0)).alias("rows"))


def archive_jobs(symbols: DataFrame, intervals: list[str], start: str, end: str, root: str) -> DataFrame:
    """(symbol, interval, date, url, checksum_url): every symbol with every interval and day from ``start`` to ``end``, both
    included, and where its archive and the archive's checksum are below ``root``."""
    each = symbols.select("symbol").distinct().select("symbol", F.explode(F.array(*map(F.lit, intervals))).alias("interval"))
    each = each.select("*", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    url = F.format_string(root.rstrip("/").replace("%", "%%") + "/%s/%s/%s-%s-%s.zip", "symbol", "interval", "symbol", "interval", F.date_format("date", "yyyy-MM-dd"))
    return each.withColumns({"url": url, "checksum_url": F.concat(url, F.lit(".CHECKSUM"))})


def read_mixed(spark: SparkSession, path: str, symbol: str, interval: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Bars of one symbol and interval from ``write_bars``' layout, whose open times may be in seconds, ms, us or ns row by row:
    in ms, from ``start`` to ``end`` (ms, both included), one row a time (the last written file's, then the greatest close).

    The bounds are one predicate for each unit, which the scan prunes row groups by; rows are told apart afterwards.
    """
    raw = spark.read.parquet(path).where((F.col("symbol") == symbol) & (F.col("interval") == canonical_interval(interval)))
    t = F.col("open_time")
    if start is not None or end is not None:
        low, high = start if start is not None else 0, end if end is not None else 10**14 - 1
        spans = [(-(-low // 1000), high // 1000), (low, high), (low * 1000, high * 1000 + 999), (low * 10**6, min(2**63 - 1, high * 10**6 + 999_999))]
        some = F.lit(False)
        for a, b in spans:
            some = some | t.between(a, b)
        raw = raw.where(some)
    rows = raw.withColumns({"open_time": epoch_ms(t), "written_": F.col("_metadata.file_modification_time")})
    if start is not None:
        rows = rows.where(F.col("open_time") >= start)
    if end is not None:
        rows = rows.where(F.col("open_time") <= end)
    return keep_last(rows, [F.col("written_"), F.col("close")]).drop("written_")


def upsert_in_place(new: DataFrame, path: str) -> None:
    """Write ``new`` bars into ``write_bars``' table at ``path``: only partitions (interval, symbol) that ``new`` touches are
    written again, the others keep their files. Then ``{path}.meta`` gets a JSON line for each of them: rows, first and
    last time, columns; it is the mark that the write is done. The same bars again change no row."""
    spark = new.sparkSession
    touched = new.select("interval", "symbol").distinct()
    old = spark.read.parquet(path).join(touched, ["interval", "symbol"], "left_semi")
    made = upsert(old.select(*new.columns), new)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "symbol").parquet(path)
    columns = F.array(*[F.lit(c) for c in new.columns])
    metadata(spark.read.parquet(path)).withColumn("columns", columns).coalesce(1).write.mode("overwrite").json(f"{path}.meta")


TRADES = "symbol string, side string, entry_time long, exit_time long, entry_price double, exit_price double, size double, pnl double, pnl_pct double, stop_loss double, take_profit double, exit_reason string"


def write_trades(trades: DataFrame, path: str) -> None:
    """Trades as CSV with a header."""
    trades.select(*[x.split()[0] for x in TRADES.split(", ")]).write.mode("overwrite").option("header", True).csv(path)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades written by ``write_trades``; a missing exit reason is empty."""
    return spark.read.schema(TRADES).option("header", True).csv(path).fillna("", ["exit_reason"])


def write_summary(metrics: DataFrame, config: dict, path: str) -> None:
    """A JSON line for each row of ``metrics``, with the run's ``config``; infinite and undefined numbers become null."""
    finite = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes]
    metrics.select(F.struct(*finite).alias("metrics"), F.lit(json.dumps(config)).alias("strategy_config")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_summary(spark: SparkSession, path: str, metrics_schema: str) -> DataFrame:
    """Summaries again: the metrics by ``metrics_schema`` and ``strategy_config`` as a map of texts."""
    raw = spark.read.schema(f"metrics struct<{metrics_schema.replace(' ', ':').replace(',:', ', ')}>, strategy_config string").json(path)
    return raw.select("metrics.*", F.from_json("strategy_config", "map<string, string>").alias("strategy_config"))
