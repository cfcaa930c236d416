"""Readers and writers by round trips; the stream of ticks against the batch query."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from barlake.operators import backtest, patterns, quality
from barlake.plans import queries as plans
from barlake.sources import bars as src
from barlake.streaming import bars as streams
from tests.compare import of_spark

SF = "/root/testdata/sf0.001"


def test_bars_written_and_read(spark, tmp_path):
    b = plans.all_bars(spark, SF)
    src.write_bars(b, f"file://{tmp_path}/bars")
    first, last = src.day_range("2024-01-03", "2024-01-05")
    symbol = b.select("symbol").first()[0]
    read = src.read_bars(spark, f"file://{tmp_path}/bars", [symbol], ["H1", "15m"], first, last)
    expected = b.where((F.col("symbol") == symbol) & F.col("interval").isin("1h", "15m") & F.col("open_time").between(first, last))
    assert of_spark(read.select(*b.columns)) == of_spark(expected) and read.count() > 0


def test_refresh(spark):
    old = spark.createDataFrame([("a", "1h", i, float(i)) for i in range(5)], "symbol string, interval string, open_time long, close double")
    new = spark.createDataFrame([("a", "1h", i, -float(i)) for i in (4, 5)], old.schema)
    assert sorted((r.open_time, r.close) for r in src.refresh(old, new, 3).collect()) == [(3, 3.0), (4, -4.0), (5, -5.0)]


def test_klines(spark, tmp_path):
    row = [1704067200000, "1.5", "2", "1", "1.75", "10", 1704067259999, "0", 3, "0", "0", "0"]
    (tmp_path / "BTCUSDT_1h.json").write_text(json.dumps([row, row]))
    found = src.read_klines_json(spark, f"file://{tmp_path}/*.json").collect()
    assert [tuple(r) for r in found] == [("BTCUSDT", "1h", 1704067200000, 1.5, 2.0, 1.0, 1.75, 10.0)] * 2
    folder = tmp_path / "ETHUSDT" / "15m"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text(",".join(map(str, row)) + "\n" + ",".join(map(str, row)) + "\n")
    read = src.read_kline_csv(spark, f"file://{folder}/a.csv").first()
    assert (read.symbol, read.interval, read.open_time, read.close) == ("ETHUSDT", "15m", 1704067200000, 1.75)
    (folder / "b.csv").write_text("open_time,open\n" + ",".join(map(str, row)) + "\n")
    (folder / "c.csv").write_text(",".join(map(str, row[:6])) + "\n")
    bad = src.misshapen(spark, f"file://{folder}/*.csv").collect()
    assert [(r.file.rsplit("/", 1)[1], r.lines, r.bad_lines) for r in bad] == [("b.csv", 2, 1)]


def test_trades_and_summary(spark, tmp_path):
    trades = plans._plain_trades(spark, SF)
    src.write_trades(trades, f"file://{tmp_path}/trades")
    assert of_spark(src.read_trades(spark, f"file://{tmp_path}/trades")) == of_spark(trades.drop("cash_after"))
    metrics = spark.createDataFrame([("a", float("inf"), 1.5), ("b", float("nan"), None)], "symbol string, profit_factor double, total_pnl double")
    src.write_summary(metrics, {"stop": 0.035}, f"file://{tmp_path}/summary")
    rows = [json.loads(line) for p in (tmp_path / "summary").glob("*.json") for line in p.read_text().splitlines()]
    assert sorted((r["metrics"]["symbol"], r["metrics"]["profit_factor"], r["metrics"]["total_pnl"]) for r in rows) == [("a", None, 1.5), ("b", None, None)]
    assert all(json.loads(r["strategy_config"]) == {"stop": 0.035} for r in rows)


def test_stream_equals_batch(spark, tmp_path):
    """Three files, one a batch: the last state of each bar is the batch query's; alerts come once."""
    ticks = plans.events(spark, SF).withColumn("ts", F.timestamp_micros("time_us"))
    day = F.to_date("ts")
    for i, part in enumerate((ticks.where(day < "2024-01-10"), ticks.where((day >= "2024-01-10") & (day < "2024-01-20")), ticks.where(day >= "2024-01-20"))):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/ticks/{i}")
    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/ticks/*")
    made = streams.stream_bars(source, "1h", late="60 days")
    made.writeStream.outputMode("complete").format("memory").queryName("streamed_bars").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert of_spark(spark.table("streamed_bars").select(*plans.bars(spark, SF).columns)) == of_spark(plans.bars(spark, SF))


def test_bounded_history_of_a_stream(spark, tmp_path):
    """Three batches: the last state of each symbol and interval is the batch refresh; broken bars stop nothing."""
    b = plans.bars(spark, SF, "1h").union(plans.bars(spark, SF, "4h")).withColumn("part", F.floor(F.col("open_time") % 864_000_000 / 288_000_000).cast("int"))
    for i in range(3):
        part = b.where(F.col("part") == i).drop("part")
        broken = part.limit(1).withColumns({"symbol": F.lit("broken"), "close": F.lit(None).cast("double")})
        again = b.where("part = 0").drop("part").withColumn("volume", F.col("volume") + i) if i else part
        part.unionByName(again).unionByName(broken).distinct().coalesce(1).write.parquet(f"file://{tmp_path}/bars/{i}")
    got: dict = {}

    def take(batch, _):
        for row in batch.collect():
            got.setdefault((row.symbol, row.interval, _), []).append(tuple(row)[2:])

    source = spark.readStream.schema(b.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/bars/*")
    streams.bounded_history(source, 40).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/state").foreachBatch(take).trigger(availableNow=True).start().awaitTermination()
    last = {key[:2]: key for key in sorted(got, key=lambda k: k[2])}
    ours = {key: sorted(got[of]) for key, of in last.items()}
    expected: dict = {}
    final = b.withColumn("volume", F.when(F.col("part") == 0, F.col("volume") + 2).otherwise(F.col("volume"))).drop("part")
    for row in src.latest(final, 40).select("symbol", "interval", "open_time", "open", "high", "low", "close", "volume").collect():
        expected.setdefault(tuple(row)[:2], []).append(tuple(row)[2:])
    assert ours == {k: sorted(v) for k, v in expected.items()}
    assert max(map(len, ours.values())) == 40


def test_status_of_symbols(spark):
    b = spark.createDataFrame([("a", 5), ("b", 50), (None, 5)], "symbol string, open_time long")
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "symbol string")
    found = {tuple(r) for r in quality.status(wanted, b, 0, 9).collect()}
    assert found == {("a", "ok", 1), ("b", "empty_range", 0), ("c", "missing", 0), (None, "missing", 0)}


def test_validation_of_all_and_checksums(spark):
    b = spark.createDataFrame([("a", "1h", i * 3_600_000, 1.0, 1.0, 1.0, 1.0, 1.0) for i in (0, 1, 3)], "symbol string, interval string, open_time long, open double, high double, low double, close double, volume double")
    found = {(r.symbol, r.interval): (r.exists, r.gap_count, r.missing_rows) for r in quality.validate_all(b, ["a", "z"], ["1h"]).collect()}
    assert found == {("a", "1h"): (True, 1, 1), ("z", "1h"): (False, None, None)}
    says = [r.suggestion for r in quality.suggestions(quality.report(b)).collect()]
    assert says == ["re-download the days around the gaps; fill or re-download missing bars"]
    files = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b"2")), ("z", bytearray(b"3"))], "path string, content binary")
    sums = spark.createDataFrame([("x", hashlib.sha256(b"1").hexdigest().upper()), ("y", "0" * 64)], "path string, sha256 string")
    assert {(r.path, r.valid) for r in quality.verify_checksums(files, sums).collect()} == {("x", True), ("y", False), ("z", True)}


def test_closed_bars(spark):
    b = spark.createDataFrame([("a", "1h", 0), ("a", "15m", 0), ("a", "1h", 3_600_000)], "symbol string, interval string, open_time long")
    assert sorted((r.interval, r.open_time) for r in streams.closed(b, 3_600_000).collect()) == [("15m", 0), ("1h", 0)]


def test_no_trade_after_one_held_to_the_end_and_none_without_cash(spark):
    made = [("s", "long", 1, 1, 5, "eod", 100.0, 100.0), ("s", "long", 5, 5, 5, "eod", 100.0, 100.0), ("r", "short", 1, 1, 3, "sl", 100.0, 250.0), ("r", "long", 4, 4, 5, "tp", 100.0, 110.0)]
    exited = spark.createDataFrame(made, "symbol string, side string, s_rn int, open_time long, exit_rn int, exit_reason string, entry double, exit_price double").selectExpr("*", "CAST(exit_rn AS BIGINT) AS exit_time", "0D AS stop_loss", "0D AS take_profit")
    rows = {(r.symbol, r.entry_time): r for r in backtest.trades(exited).collect()}
    assert set(rows) == {("s", 1), ("r", 1)} and rows["r", 1].cash_after < 0


def test_engulfing_as_intended_needs_the_larger_body(spark):
    bars = spark.createDataFrame([("a", i, *x) for i, x in enumerate([(10.0, 10.5, 8.0, 9.0), (8.9, 11.0, 8.8, 10.2), (10.2, 10.3, 9.0, 9.5)])], "symbol string, open_time long, open double, high double, low double, close double")
    flags = [r.pat_bull_engulfing for r in patterns.candles(bars, intended=True).orderBy("open_time").collect()]
    assert flags == [0, 1, 0]
