"""The feature matrix's plan and sinks, the grid, correlations, grid as-of joins, and readers and reports added with them."""

from __future__ import annotations

import json
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.functions.carry import average
from barlake.operators import align, backtest, features, indicators, quality
from barlake.plans import queries as plans
from barlake.sources import bars as src
from tests.compare import of_duckdb, of_spark

SF = "/root/testdata/sf0.001"


def _exchanges(df):
    return df._jdf.queryExecution().optimizedPlan(), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_exchanges_of_the_matrix(spark, tmp_path):
    """From bars on disk: one exchange for the pass of arrays, one for what looks back by rows, one for the base rows; no join."""
    of = {}
    for i, b in plans._three(spark, SF).items():
        b.write.parquet(f"file://{tmp_path}/{i}")
        of[i] = spark.read.parquet(f"file://{tmp_path}/{i}")
    _, matrix = _exchanges(features.matrix(of))
    made = features.feature_matrix(of)
    _, whole = _exchanges(made)
    assert matrix == whole == 3
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_the_matrix(spark):
    of = plans._three(spark, SF)
    made = features.feature_matrix(of)
    assert len(indicators.TECHNICAL) == len(set(indicators.TECHNICAL)) == 39
    assert {f"{i}_{c}" for i in of for c in indicators.TECHNICAL} <= set(made.columns) and len(made.columns) == len(set(made.columns))
    assert {"1h_open", "4h_sr_nearest_support", "regime_M15", "regime_H1", "regime_H4", "swing_is_high", "swing_bars_since_low", *features.LABELS} <= set(made.columns)
    names = features.feature_names(made)
    assert not {"symbol", "open_time"} & set(names) and not any(c.startswith("target_") for c in names)
    only = features.feature_matrix({"15m": of["15m"]})
    assert "1h_open" not in only.columns and only.count() == of["15m"].count()


def test_features_written_and_read(spark):
    made = features.matrix(plans._three(spark, SF))
    features.write_features(made, "features_of_test", 4)
    first, last = src.day_range("2024-01-03", "2024-01-08")
    read = features.read_features(spark, "features_of_test", ["click"], first, last)
    assert of_spark(read.select(*made.columns)) == of_spark(made.where((F.col("symbol") == "click") & F.col("open_time").between(first, last))) and read.count() > 0
    later = features.read_features(spark, "features_of_test").groupBy("symbol").agg(F.max("15m_obv"))
    assert _exchanges(later)[1] == 0
    spark.sql("DROP TABLE features_of_test")


def test_averages_in_parts():
    """An average over many batches is that of the plain recurrence; nulls at the start shift it."""
    draw = np.random.default_rng(1)
    x = np.concatenate([[np.nan] * 3, draw.normal(size=2000)])
    state, parts = None, []
    for lo in range(0, len(x), 77):
        state, y = average(state, x[lo : lo + 77], 1 / 14, 14)
        parts.append(y)
    expected = pd.Series(x).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean().to_numpy()
    assert np.allclose(np.concatenate(parts), expected, rtol=1e-9, equal_nan=True)


def test_bundles_by_family(spark):
    b = plans.bars(spark, SF)
    names = lambda df: set(df.columns) - set(b.columns)
    assert names(indicators.trend(b)) == {"ema_12", "ema_26", "ema_50", "ema_200", "macd", "macd_signal", "macd_hist", "adx", "plus_di", "minus_di", "supertrend_p10_m3_0", "supertrend_direction_p10_m3_0"}
    assert names(indicators.momentum(b)) == {"rsi_7", "rsi_14", "rsi_21", "stoch_k", "stoch_d", "williams_r_14", "williams_r_28"}
    assert names(indicators.volatility(b)) == {"bb_mid", "bb_upper", "bb_lower", "bb_pct_b", "bb_bandwidth", "atr_14", "atr_21", "keltner_mid", "keltner_upper", "keltner_lower"}
    assert names(indicators.volumes(b)) == {"obv", "vwap", "vp_poc"}
    tech = indicators.technical(b).select("symbol", "open_time", "rsi_14", "obv", "vp_poc")
    other = indicators.volumes(indicators.rsi(b, [14])).select(*tech.columns)
    assert of_spark(tech) == of_spark(other)


def test_correlations_leave_out_what_does_not_vary(spark):
    draw = random.Random(1)
    rows = [(float(i % 7), draw.random(), 3.0, None if i % 3 else 1.0 * i, float("nan") if i % 2 else float(i), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, constant double, few double, holes double, y double").withColumn("zero", F.lit(1.5))
    found = {r.feature: (r.pearson, r.n) for r in backtest.correlations(df, ["a", "b", "constant", "few", "holes"], "y").collect()}
    plain = pd.DataFrame(rows, columns=["a", "b", "constant", "few", "holes", "y"])
    assert set(found) == {"a", "b", "holes"} and found["holes"][1] == 60
    for c, (r, _) in found.items():
        assert r == pytest.approx(plain["y"].corr(plain[c]), abs=1e-9)
    assert backtest.correlations(df, ["a", "b"], "zero").count() == 0 and backtest.spearman(df, ["a", "b"], "zero").count() == 0
    ranks = {r.feature: r.correlation for r in backtest.spearman(df, ["a", "b", "constant"], "y").collect()}
    assert set(ranks) == {"a", "b"} and ranks["b"] == pytest.approx(plain["y"].rank().corr(plain["b"].rank()), abs=1e-9)
    assert [r.feature for r in backtest.correlations(df, ["a", "b", "holes"], "y", top=1).collect()] == ["holes"]


def test_metrics_of_symbols_without_trades(spark):
    trades = plans._plain_trades(spark, SF)
    symbols = plans.bars(spark, SF).select("symbol").union(spark.createDataFrame([("idle",)], "symbol string"))
    found = {r.symbol: r for r in backtest.metrics(trades, symbols=symbols).collect()}
    idle = found["idle"]
    assert (idle.n_trades, idle.win_rate, idle.profit_factor, idle.final_equity, idle.total_return_pct, idle.avg_win) == (0, 0.0, 0.0, 10_000.0, 0.0, 0.0)
    assert {k: tuple(v) for k, v in found.items() if k != "idle"} == {r.symbol: tuple(r) for r in backtest.metrics(trades).select(*idle.asDict()).collect()}


def test_rise_from_zero_is_an_outlier(spark):
    b = spark.createDataFrame([("a", "1h", i * 3_600_000, c, c, c, c, 1.0) for i, c in enumerate([1.0, 0.0, 5.0, 0.0, 0.0, 5.1])], "symbol string, interval string, open_time long, open double, high double, low double, close double, volume double")
    assert quality.report(b).first().outliers == 4  # down, up, down, up; 0 to 0 is none


def test_quality_report_after_zero_closes_is_that_of_its_sql(spark, tmp_path):
    """At sf0.1 two bars of 15 minutes close at 0; the tables of the other tests have none."""
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {15 * i} MINUTE, {i}, 'view', {v}, '')" for i, v in enumerate([1.0, 0.0, 5.0, 0.0, 0.0, 5.1, 5.0]))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    for name in ("quality_report", "quality_by_interval", "low_quality_symbols", "repair_plan"):
        assert of_spark(plans.queries()[name](spark, str(tmp_path))) == of_duckdb(plans.oracle_sql()[name], str(tmp_path)), name


def test_grid_asof_with_gaps(spark):
    """Rows in gaps of any length, before the first row, and beyond all levels, as the window finds them."""
    draw = random.Random(4)
    left = spark.createDataFrame([(s, t * 900_000) for s in "ab" for t in draw.sample(range(-50, 60_000), 700)] + [("c", 5)], "symbol string, open_time long")
    held = [(s, t * 3_600_000, float(t)) for s in "ab" for t in sorted(draw.sample(range(0, 40), 20) + draw.sample(range(1500, 9000), 40))]
    right = spark.createDataFrame(held, "symbol string, open_time long, x double")
    assert of_spark(align.asof_grid(left, right, 3_600_000)) == of_spark(align.asof(left, right))
    assert "Window" not in align.asof_grid(left, right, 3_600_000)._jdf.queryExecution().optimizedPlan().toString()


def test_grid_of_one_run_is_a_backtest(spark):
    """Each run of a grid has the trades of the plain way with its parameters."""
    b = plans.bars(spark, SF)
    signals = plans._plain_signals(b)
    asked = signals.select("symbol", "open_time", "side", "entry").withColumn("i_span", F.lit(0))
    stops, targets, hours = [0.01, 0.2], [0.02, 0.3], [3.0, 24.0, 4000.0]
    runs = backtest.parameter_runs(spark, {"i_span": [0], "i_stop": [0, 1], "i_target": [0, 1], "i_hours": [0, 1, 2]})
    found = {r.run_id: r for r in backtest.grid(asked, b, runs, "i_span", stops, targets, hours).collect()}
    assert sorted(found) == list(range(12))
    for k in (0, 5, 10):
        i, j, h = k // 6, k // 3 % 2, k % 3
        long_, C = F.col("side") == "long", F.col("entry")
        own = signals.withColumns({"stop_loss": F.when(long_, C * (1 - stops[i])).otherwise(C * (1 + stops[i])), "take_profit": F.when(long_, C * (1 + targets[j])).otherwise(C * (1 - targets[j])), "deadline": (F.col("open_time") + int(hours[h] * 3_600_000)).cast("long")})
        rows = backtest.trades(backtest.exits(own, b)).collect()
        assert found[k].total_trades == len(rows) and found[k].gross_profit == pytest.approx(sum(r.pnl for r in rows if r.pnl > 0))


def test_reports_summaries_and_status(spark, tmp_path):
    trades = plans._plain_trades(spark, SF)
    for r in backtest.trade_report(trades, None).collect():
        assert sum(json.loads(r.losers_by_exit_reason).values()) == r.n_losers == sum(json.loads(r.loser_entry_hour_utc_counts).values())
        assert isinstance(json.loads(r.hypotheses), list)
    m = backtest.metrics(trades).select("symbol", "win_rate", "n_trades")
    src.write_summary(m, {"stop": 0.035, "name": "x"}, f"file://{tmp_path}/s")
    read = src.read_summary(spark, f"file://{tmp_path}/s", "symbol string, win_rate double, n_trades bigint")
    assert of_spark(read.drop("strategy_config")) == of_spark(m) and read.first().strategy_config == {"stop": "0.035", "name": "x"}
    status = quality.status(spark.createDataFrame([("click",), ("none",)], "symbol string"), plans.bars(spark, SF), 0, 2**50)
    assert {(r.status, r.n) for r in backtest.run_status(status).collect()} == {("ok", 1), ("missing", 1)}


def test_trade_report_without_winners_or_losers_is_that_of_its_sql(spark, tmp_path):
    """Hourly bars, the seventh a short: of ``down`` it wins, of ``up`` it loses, of ``flat`` it has one later bar."""
    prices = {"down": [100.0] * 7 + [90.0] * 3, "up": [100.0] * 7 + [110.0] * 3, "flat": [100.0] * 8, "none": [100.0] * 3}
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {i} HOUR, {i}, '{s}', {v}, '')" for s, p in prices.items() for i, v in enumerate(p))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    ours = of_spark(plans.trade_report(spark, str(tmp_path)))
    assert ours == of_duckdb(plans.oracle_sql()["trade_report"], str(tmp_path))
    found = {r.symbol: (r.winners_by_exit_reason, r.losers_by_exit_reason, r.loser_entry_hour_utc_counts) for r in plans.trade_report(spark, str(tmp_path)).collect()}
    assert found == {"down": ('{"tp":1}', None, None), "up": (None, '{"sl":1}', '{"06":1}'), "flat": (None, '{"eod":1}', '{"06":1}')}


def test_upsert_in_place(spark, tmp_path):
    """Only touched partitions are written again; the same bars again change no row; metadata follows."""
    path = f"{tmp_path}/bars"
    b = plans.all_bars(spark, SF)
    src.write_bars(b, f"file://{path}")
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("*.parquet")}
    new = b.where("symbol = 'click' AND interval = '1h'").limit(3).withColumn("close", F.col("close") + 1).cache()
    new.count()
    for _ in range(2):
        src.upsert_in_place(new, f"file://{path}")
        read = spark.read.parquet(f"file://{path}")
        assert of_spark(read.select(*b.columns)) == of_spark(src.upsert(b, new))
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("*.parquet")}
    assert all("interval=1h/symbol=click" in p for p in set(before) ^ set(after)) and all(before[p] == after[p] for p in set(before) & set(after))
    meta = [json.loads(x) for p in (tmp_path / "bars.meta").glob("*.json") for x in p.read_text().splitlines()]
    assert sum(m["row_count"] for m in meta) == b.count() and all("close" in m["columns"] for m in meta)


def test_later_repeat_wins(spark):
    one = spark.createDataFrame([("a", "1h", 0, 9.0, 1), ("a", "1h", 0, 5.0, 2)], "symbol string, interval string, open_time long, close double, load long")
    assert src.upsert(one.limit(0), one, "load").first().close == 5.0
    assert src.upsert(one, one.limit(0), "load").first().close == 5.0


def test_times_of_mixed_units(spark, tmp_path):
    """Seconds, ms, us and ns in one table: one row a time, bounds pushed into the scan."""
    t0 = 1_704_067_200_000
    rows = [("a", "1h", v, float(k)) for k in range(24) for v in [(t0 + k * 3_600_000) * 1 // 1000, t0 + k * 3_600_000, (t0 + k * 3_600_000) * 1000, (t0 + k * 3_600_000) * 10**6][k % 4 : k % 4 + 1 + k % 2]]
    df = spark.createDataFrame(rows, "symbol string, interval string, open_time long, close double").selectExpr("*", "close AS open", "close AS high", "close AS low", "1D AS volume")
    src.write_bars(df, f"file://{tmp_path}/mixed")
    found = src.read_mixed(spark, f"file://{tmp_path}/mixed", "a", "H1", t0 + 3_600_000, t0 + 9 * 3_600_000)
    assert sorted((r.open_time, r.close) for r in found.collect()) == [(t0 + k * 3_600_000, float(k)) for k in range(1, 10)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in plan and "PushedFilters: [Or(" in plan


def test_files_jobs_and_backfill(spark, tmp_path):
    folder = tmp_path / "A" / "1h"
    folder.mkdir(parents=True)
    (folder / "empty.csv").write_text("")
    (folder / "six.csv").write_text("1704067200000,1,2,0.5,1.5,10\n")
    (folder / "five.csv").write_text("1704067200000,1,2,0.5,1.5\n")
    (folder / "text.csv").write_text("time,1,2,0.5,1.5,10\n")
    path = f"file://{folder}/*.csv"
    assert {r.file.rsplit("/", 1)[1] for r in src.misshapen(spark, path).collect()} == {"empty.csv", "five.csv", "text.csv"}
    assert tuple(src.extraction_report(spark, path).first()) == (1, 3, 1)
    jobs = src.archive_jobs(spark.createDataFrame([("A",), ("B",), ("A",)], "symbol string"), ["1h", "4h"], "2024-02-28", "2024-03-01", "https://x.example/k/").collect()
    assert len(jobs) == 12 and {j.url for j in jobs} >= {"https://x.example/k/A/1h/A-1h-2024-02-29.zip"} and all(j.checksum_url == j.url + ".CHECKSUM" for j in jobs)
    b = spark.createDataFrame([("a", "1h", 36_000_000), ("a", "1h", 39_600_000), ("b", "1h", 0), ("b", "1h", 1), ("b", "1h", 2)], "symbol string, interval string, open_time long")
    assert [tuple(r) for r in src.backfill(b, 3).collect()] == [("a", "1h", 32_400_000, 35_999_999)]


def test_raw_bars_side_and_times(spark):
    of = plans._three(spark, SF)
    got = features.with_raw_bars(of["15m"].drop("interval"), of, "15m")
    want = align.align(of).select("symbol", "open_time", *[f"{i}_{c}" for i in of for c in features.RAW])
    assert of_spark(got.select(*want.columns)) == of_spark(want)
    times = spark.createDataFrame([("1704067200000",), ("2024-01-01 00:00:00",), ("2024-01-01T00:00:00Z",), ("2024/01/01 00:00:00",), ("x",), (None,)], "t string")
    assert [r[0] for r in times.select(features.time_ms(F.col("t"))).collect()] == [1704067200000] * 4 + [None, None]
    flags = spark.createDataFrame([(True, True), (False, True), (False, False)], "strat_long_setup boolean, strat_short_setup boolean")
    assert [r.signal_side for r in backtest.signal_side(flags).collect()] == ["long", "short", None]
