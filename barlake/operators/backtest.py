"""Signals, exits and trades. Everything is joins and windows; no Python runs on executors but for Supertrend.

A signal table has symbol, open_time, side (long or short), entry (close), stop_loss, take_profit and deadline (ms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.functions.links import along, first_from
from barlake.functions.scratch import Written
from barlake.functions.windows import by_time, ewm, rolling

from .align import asof
from .indicators import previous, supertrend


def strategy_rsi(bars: DataFrame, p: int = 14) -> DataFrame:
    """``rsi``: Wilder's averages from the first change on; 50 where undefined or without losses."""
    C = F.col("close")
    change = C - previous(C)
    moved = bars.withColumns({"g_": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "l_": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))})
    out = ewm(moved, {"ga_": ("g_", 1 / p, 1), "la_": ("l_", 1 / p, 1)})
    return out.withColumn("rsi", F.coalesce(100 - 100 / (1 + F.try_divide("ga_", "la_")), F.lit(50.0))).drop("g_", "l_", "ga_", "la_")


def strategy_candles(bars: DataFrame) -> DataFrame:
    """Bullish and bearish engulfing, hammer or pin, as one flag a side (strict forms)."""
    O, H, L, C = (F.col(c) for c in ("open", "high", "low", "close"))
    body, rng = F.abs(C - O), H - L
    up, low = H - F.greatest(O, C), F.least(O, C) - L
    o1, c1 = previous(O), previous(C)
    some = F.nullif(body, F.lit(0.0))
    bull = [(c1 < o1) & (C > O) & (C > o1) & (O < c1), (body <= 0.35 * rng) & (low >= 2 * some) & (up <= body), (low >= 2 * body) & (up <= 0.6 * body) & (rng > 0)]
    bear = [(c1 > o1) & (C < O) & (C < o1) & (O > c1), (body <= 0.35 * rng) & (up >= 2 * some) & (low <= body), (up >= 2 * body) & (low <= 0.6 * body) & (rng > 0)]

    def one(conditions: list[Column]) -> Column:
        return F.coalesce(conditions[0], F.lit(False)) | F.coalesce(conditions[1], F.lit(False)) | F.coalesce(conditions[2], F.lit(False))

    return bars.withColumns({"bull_candle": one(bull), "bear_candle": one(bear)})


def setups(base: DataFrame, mid: DataFrame, high: DataFrame, span: int = 200, swing: int = 64, rsi_long: float = 42, rsi_short: float = 60, st: tuple[int, float] = (10, 3.0), spans: list[int] | None = None) -> DataFrame:
    """``base`` with strat_long_setup and strat_short_setup: trend of the high interval, pullback zone of the middle one, RSI
    and candles of the base. The higher intervals are taken as of each base row, then averaged over base rows.

    ``spans``: setups of several spans in one pass, as ``strat_long_setup_{span}`` and ``strat_short_setup_{span}``.
    """
    up = high.select("symbol", "open_time", *[F.col(c).alias(f"h_{c}") for c in ("high", "low", "close")])
    zone = mid.select("symbol", "open_time", *[F.col(c).alias(f"m_{c}") for c in ("high", "low", "close")])
    out = strategy_candles(strategy_rsi(asof(asof(base, zone), up)))
    out = ewm(out, {f"h_ema_{n}": ("h_close", 2 / (n + 1), 1) for n in spans or [span]})
    trend = supertrend(out.where("h_close IS NOT NULL").select("symbol", "open_time", F.col("h_high").alias("high"), F.col("h_low").alias("low"), F.col("h_close").alias("close")), *st)
    out = out.join(trend, ["symbol", "open_time"], "left")
    hi, lo = rolling(F.max("m_high"), F.col("m_high"), swing, swing // 2), rolling(F.min("m_low"), F.col("m_low"), swing, swing // 2)
    out = out.withColumns({"sw_hi": hi, "sw_span": F.nullif(hi - lo, F.lit(0.0)), "sw_lo": lo})
    m, span_ = F.col("m_close"), F.col("sw_span")
    long_zone = m.between(F.col("sw_hi") - 0.786 * span_, F.col("sw_hi") - 0.618 * span_)
    short_zone = m.between(F.col("sw_lo") + 0.618 * span_, F.col("sw_lo") + 0.786 * span_)
    made = {}
    for n in spans or [span]:
        long_ = (F.col("h_close") > F.col(f"h_ema_{n}")) & (F.col("supertrend_dir") == 1) & long_zone & F.col("bull_candle") & (F.col("rsi") <= rsi_long)
        short = (F.col("h_close") < F.col(f"h_ema_{n}")) & (F.col("supertrend_dir") == -1) & short_zone & F.col("bear_candle") & (F.col("rsi") >= rsi_short)
        made |= {f"strat_{k}_setup" + (f"_{n}" if spans else ""): F.coalesce(x, F.lit(False)) for k, x in (("long", long_), ("short", short))}
    return out.withColumns(made)


def signal_side(prepared: DataFrame) -> DataFrame:
    """All rows of ``prepared`` with ``signal_side``: long, short or null; long goes first."""
    side = F.when(F.col("strat_long_setup"), "long").when(F.col("strat_short_setup"), "short")
    return prepared.withColumn("signal_side", side)


def signals_of_spans(prepared: DataFrame, spans: list[int]) -> DataFrame:
    """(symbol, open_time, side, entry, i_span) of every setup of ``setups`` with ``spans``; ``i_span`` counts from 0."""
    each = F.array(*[F.when(F.col(f"strat_long_setup_{n}") | F.col(f"strat_short_setup_{n}"), F.struct(F.lit(i).alias("i_span"), F.when(F.col(f"strat_long_setup_{n}"), "long").otherwise("short").alias("side"))) for i, n in enumerate(spans)])
    return prepared.select("symbol", "open_time", F.col("close").alias("entry"), F.inline(F.filter(each, lambda x: x.isNotNull())))


def signals(prepared: DataFrame, stop: float = 0.035, target: float = 0.065, hours: float = 96) -> DataFrame:
    """Rows of ``prepared`` with a setup, as signals; long goes first."""
    C = F.col("close")
    long_ = F.col("strat_long_setup")
    side = F.when(long_, "long").otherwise("short")
    return prepared.where(long_ | F.col("strat_short_setup")).select(
        "symbol", "open_time", side.alias("side"), C.alias("entry"), F.when(long_, C * (1 - stop)).otherwise(C * (1 + stop)).alias("stop_loss"),
        F.when(long_, C * (1 + target)).otherwise(C * (1 - target)).alias("take_profit"), (F.col("open_time") + int(hours * 3_600_000)).cast("long").alias("deadline"),
    )


def until_due(signals_: DataFrame, numbered: DataFrame) -> DataFrame:
    """``signals_`` with ``t_rn``, the number of the first bar at or after the deadline, null if there is none."""
    marks = numbered.select("symbol", F.col("open_time").alias("at_"), F.col("rn").alias("found_"))
    due = first_from(marks, signals_.select("symbol", F.col("deadline").alias("at_")), 1 << 32)
    return signals_.join(due.select("symbol", F.col("at_").alias("deadline"), F.col("found_").alias("t_rn")), ["symbol", "deadline"], "left")


def exits(signals_: DataFrame, bars: DataFrame, cell: int = 64) -> DataFrame:
    """Each signal with exit_time, exit_price, exit_reason: the first later bar that touches the stop (first), the target, or
    the deadline; else the symbol's last bar (eod).

    The window to search ends at the first bar at or after the deadline. It is cut into cells of ``cell`` bars, so that the
    range becomes an equi-join on (symbol, cell).
    """
    numbered = bars.select("symbol", "open_time", "high", "low", "close", F.row_number().over(by_time()).alias("rn"))
    ends = numbered.groupBy("symbol").agg(F.max("rn").alias("last_rn"))
    s = signals_.join(numbered.select("symbol", "open_time", F.col("rn").alias("s_rn")), ["symbol", "open_time"]).join(ends, "symbol")
    s = until_due(s, numbered).withColumn("to_rn", F.coalesce("t_rn", "last_rn"))
    cells = s.where("to_rn > s_rn").withColumn("cell", F.explode(F.sequence(F.expr(f"cast((s_rn + 1) div {cell} as int)"), F.expr(f"cast(to_rn div {cell} as int)"))))
    part = numbered.select("symbol", F.expr(f"cast(rn div {cell} as int)").alias("cell"), "rn", "high", "low", F.col("open_time").alias("b_time"), F.col("close").alias("b_close"))
    hit = cells.join(part, ["symbol", "cell"]).where("rn > s_rn AND rn <= to_rn")
    long_ = F.col("side") == "long"
    sl = (long_ & (F.col("low") <= F.col("stop_loss"))) | (~long_ & (F.col("high") >= F.col("stop_loss")))
    tp = (long_ & (F.col("high") >= F.col("take_profit"))) | (~long_ & (F.col("low") <= F.col("take_profit")))
    why = F.when(sl, "sl").when(tp, "tp").when(F.col("rn") == F.col("t_rn"), "time")
    price = F.when(sl, F.col("stop_loss")).when(tp, F.col("take_profit")).otherwise(F.col("b_close"))
    keys = ["symbol", "open_time", "side", "entry", "stop_loss", "take_profit", "deadline", "s_rn", "last_rn"]
    first = hit.where(why.isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(F.col("b_time").alias("exit_time"), price.alias("exit_price"), why.alias("exit_reason"), F.col("rn").alias("exit_rn")), "rn").alias("x"))
    last = numbered.select("symbol", F.col("rn").alias("last_rn"), F.struct(F.col("open_time").alias("exit_time"), F.col("close").alias("exit_price"), F.lit("eod").alias("exit_reason"), F.col("rn").alias("exit_rn")).alias("e"))
    return s.select(*keys).join(first.select("symbol", "open_time", "x"), ["symbol", "open_time"], "left").join(last, ["symbol", "last_rn"]).withColumn("x", F.coalesce("x", "e")).select(*keys[:-1], "x.*")


def trades(exited: DataFrame, capital: float = 10_000.0, fee: float = 0.001, bps: float = 5.0) -> DataFrame:
    """Trades that do not overlap, in order, each with all cash: sizes, fills, profit and cash after.

    A signal is taken if no trade is open at it (one that ends on its bar is over, one held to the end of the data is not)
    and cash is left: a short can lose more than all. Of signals on one bar, the least by side and prices counts; those
    without prices do not.

    Each signal has a link to the first one at which its trade would be over, and the factor by which its trade changes the
    cash; the trades are what lies on the path of these links from a symbol's first signal. ``exited`` is written once, as the
    turns along the path read it again.
    """
    slip = bps / 1e4
    bought, sold = F.col("entry") * (1 + slip) * (1 + fee), F.col("entry") * (1 - slip)
    long_after = F.try_divide(F.lit(1.0), bought) * F.col("exit_price") * (1 - slip) * (1 - fee)
    short_after = 1 + F.try_divide(F.lit(1.0), sold * (1 + fee)) * (sold * (1 - fee) - F.col("exit_price") * (1 + slip) * (1 + fee))
    known = exited.withColumns({"id": F.col("s_rn").cast("long"), "free_": F.col("exit_rn").cast("long") + (F.col("exit_reason") == "eod").cast("long"), "factor": F.when(F.col("side") == "long", long_after).otherwise(short_after)})
    known = known.where("factor IS NOT NULL AND free_ IS NOT NULL")
    row = F.struct(*[F.col(c) for c in known.columns if c not in ("symbol", "id")])
    known = Written(exited.sparkSession, "trades").write(known.groupBy("symbol", "id").agg(F.min_by(row, F.struct("side", "entry", "exit_price", "free_")).alias("x")).select("symbol", "id", "x.*"))
    marks = known.select("symbol", F.col("id").alias("at_"), F.col("id").alias("found_"))
    over = first_from(marks, known.select("symbol", F.col("free_").alias("at_")), 4096)
    linked = known.join(over.select("symbol", F.col("at_").alias("free_"), F.col("found_").alias("next")), ["symbol", "free_"])
    # who has lost all stays without cash
    path = along(linked.select("symbol", "id", "next", F.greatest("factor", F.lit(0.0)).alias("factor")), capital).where("value > 0")
    taken = known.join(path, ["symbol", "id"]).withColumns({"cash_before": F.col("value"), "cash_after": F.col("value") * F.col("factor")})
    long_ = F.col("side") == "long"
    fin = F.when(long_, F.col("entry") * (1 + slip)).otherwise(F.col("entry") * (1 - slip))
    fout = F.when(long_, F.col("exit_price") * (1 - slip)).otherwise(F.col("exit_price") * (1 + slip))
    out = taken.withColumns({"entry_price": fin, "fill": fout})
    out = out.withColumn("size", F.col("cash_before") / (F.col("entry_price") * (1 + fee))).withColumn("pnl", F.col("cash_after") - F.col("cash_before"))
    return out.select("symbol", "side", F.col("open_time").alias("entry_time"), "exit_time", "entry_price", F.col("fill").alias("exit_price"), "size", "pnl", (F.col("pnl") / (F.col("size") * F.col("entry_price")) * 100).alias("pnl_pct"), "stop_loss", "take_profit", "exit_reason", "cash_after")


def equity(trades_: DataFrame, bars: DataFrame, capital: float = 10_000.0, fee: float = 0.001) -> DataFrame:
    """(symbol, open_time, equity): cash, or the open trade marked at the close (a short with its entry's fee paid)."""
    C = F.col("close")
    t = trades_.select("symbol", F.col("entry_time").alias("open_time"), "side", F.col("entry_time").alias("in_"), F.col("exit_time").alias("out_"), "size", "entry_price", "cash_after", (F.col("cash_after") - F.col("pnl")).alias("cash_before"))
    held = asof(bars.select("symbol", "open_time", "close"), t)
    open_ = (F.col("open_time") >= F.col("in_")) & (F.col("open_time") < F.col("out_"))
    mark = F.when(F.col("side") == "long", F.col("size") * C).otherwise(F.col("cash_before") + F.col("size") * (F.col("entry_price") * (1 - fee) - C))
    return held.select("symbol", "open_time", F.when(F.col("in_").isNull(), capital).when(open_, mark).otherwise(F.col("cash_after")).alias("equity"))


def metrics(trades_: DataFrame, by: str = "symbol", capital: float = 10_000.0, symbols: DataFrame | None = None) -> DataFrame:
    """Counts, win rate, profit factor, sums and means of each ``by``; trades without profit count as lost.

    ``symbols``: a table with all values of ``by``; those without a trade have zeros and their capital.
    """
    win = F.col("pnl") > 0

    def mean(x: str, of: Column) -> Column:
        return F.coalesce(F.avg(F.when(of, F.col(x))), F.lit(0.0))

    gain, loss = F.coalesce(F.sum(F.when(win, F.col("pnl"))), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(~win, F.col("pnl"))), F.lit(0.0)))
    out = trades_.groupBy(by).agg(
        F.lit(capital).alias("initial_capital"), F.count("*").alias("n_trades"), F.count_if(win).alias("winning_trades"), F.count_if(~win).alias("losing_trades"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_trade_pnl"),
        mean("pnl", win).alias("avg_win"), mean("pnl", ~win).alias("avg_loss"), mean("pnl_pct", win).alias("avg_return_win_pct"), mean("pnl_pct", ~win).alias("avg_return_loss_pct"), gain.alias("gross_profit"), loss.alias("gross_loss_abs"),
    )
    factor = F.when(F.col("gross_loss_abs") > 1e-12, F.col("gross_profit") / F.col("gross_loss_abs")).when(F.col("gross_profit") > 0, F.lit(float("inf"))).otherwise(0.0)
    if symbols is not None:
        zeros = {c: F.coalesce(c, F.lit(capital if c == "initial_capital" else 0).cast(t)).alias(c) for c, t in out.dtypes if c != by}
        out = symbols.select(by).where(F.col(by).isNotNull()).distinct().join(out, by, "left").select(by, *zeros.values())
    return out.withColumns({"win_rate": F.coalesce(F.try_divide("winning_trades", "n_trades"), F.lit(0.0)), "profit_factor": factor, "final_equity": capital + F.col("total_pnl"), "total_return_pct": F.col("total_pnl") / capital * 100})


def loser_report(trades_: DataFrame, by: str = "symbol") -> DataFrame:
    """How the trades of each ``by`` went and ended: shares by exit among losers and winners, the losers' mean and median,
    and the mean distance of their stops in % of the entry."""
    win = F.col("pnl") > 0

    def share(reason: str, of: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(of & (F.col("exit_reason") == reason)), F.count_if(of)), F.lit(0.0))

    risk = F.when(~win & (F.col("exit_reason") == "sl"), F.abs(F.try_divide(F.col("entry_price") - F.col("stop_loss"), F.col("entry_price"))) * 100)
    lost = F.when(~win, F.col("pnl"))
    return trades_.groupBy(by).agg(
        F.count("*").alias("n_total"), F.count_if(win).alias("n_winners"), F.count_if(~win).alias("n_losers"), (F.count_if(win) / F.count("*")).alias("win_rate"),
        share("sl", ~win).alias("sl_share_among_losers"), share("tp", ~win).alias("tp_share_among_losers"), share("time", ~win).alias("time_share_among_losers"), share("tp", win).alias("tp_share_among_winners"),
        F.coalesce(F.avg(lost), F.lit(0.0)).alias("avg_loser_pnl"), F.coalesce(F.median(lost), F.lit(0.0)).alias("median_loser_pnl"), F.avg(risk).alias("mean_sl_risk_pct_when_sl"),
    )


def trade_report(trades_: DataFrame, by: str | None = "symbol") -> DataFrame:
    """``loser_report`` of each ``by`` (None: of all), with maps and what they suggest: ``losers_by_exit_reason`` and
    ``winners_by_exit_reason``, ``loser_entry_hour_utc_counts`` and ``hypotheses``, as JSON texts with keys in order. A map
    without entries (no losers, no winners) is null.

    Counted by group and key first, so that a map is made of a few dozen rows.
    """
    all_ = trades_.withColumn("all_", F.lit("all")) if by is None else trades_
    key = by or "all_"
    win = F.col("pnl") > 0
    hour = F.hour(F.timestamp_millis("entry_time"))
    counted = all_.select(key, F.inline(F.array(F.struct(F.when(win, "winners_by_exit_reason").otherwise("losers_by_exit_reason").alias("map"), F.coalesce("exit_reason", F.lit("")).alias("k")), F.struct(F.when(~win, "loser_entry_hour_utc_counts").alias("map"), F.lpad(hour.cast("string"), 2, "0").alias("k")))))
    cells = counted.where("map IS NOT NULL").groupBy(key, "map", "k").agg(F.count("*").alias("n"))
    names = ["losers_by_exit_reason", "winners_by_exit_reason", "loser_entry_hour_utc_counts"]
    found = cells.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("map") == m, F.struct("k", "n")))).alias(m) for m in names])
    maps = found.select(key, *[F.when(F.size(m) > 0, F.to_json(F.map_from_entries(m))).alias(m) for m in names])
    out = loser_report(all_, key).join(maps, key)
    says = F.array_compact(F.array(
        F.when((F.col("sl_share_among_losers") > 0.55) & (F.col("n_losers") >= 5), F.lit("most losers hit the stop: it may be too tight, or entries too noisy")),
        F.when((F.col("time_share_among_losers") > 0.35) & (F.col("n_losers") >= 5), F.lit("many losers end by time: hold longer or give up earlier")),
        F.when((F.col("tp_share_among_winners") < 0.25) & (F.col("n_winners") >= 5), F.lit("few winners reach the target: it may be too far")),
    ))
    return out.withColumn("hypotheses", F.to_json(says))


def exit_shares(trades_: DataFrame) -> DataFrame:
    """How trades ended, for all, winners and losers."""
    win = F.col("pnl") > 0
    return trades_.groupBy("exit_reason").agg(F.count("*").alias("trades"), F.count_if(win).alias("winners"), F.count_if(~win).alias("losers"), F.avg("pnl").alias("mean_pnl"))


def loser_hours(trades_: DataFrame) -> DataFrame:
    return trades_.where("pnl <= 0").groupBy(F.hour(F.timestamp_millis("entry_time")).alias("hour")).agg(F.count("*").alias("losers"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' metrics (metric, value) side by side with the change."""
    return a.select("metric", F.col("value").alias("value_a")).join(b.select("metric", F.col("value").alias("value_b")), "metric", "full").withColumn("delta", F.col("value_b") - F.col("value_a"))


def drawdown(returns: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Mean, Sharpe ratio and greatest fall of the summed returns of each ``by``."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = returns.withColumn("sum_", F.sum(value).over(w)).withColumn("fall_", F.max("sum_").over(w) - F.col("sum_"))
    return run.groupBy(by).agg(F.avg(value).alias("mean_return"), (F.avg(value) / (F.stddev_pop(value) + 1e-6)).alias("sharpe"), F.max("fall_").alias("max_drawdown"))


def trade_labels(signals_: DataFrame, bars: DataFrame, rows: int, cell: int = 64) -> DataFrame:
    """For each signal, over the ``rows`` bars after it: whether the target comes before the stop (both at once: no), the
    extremes against and for it, and these in % of the entry. Signals without a later bar are left out.

    Bars are joined by cells of ``cell`` bars to the few signals that reach into them.
    """
    numbered = bars.select("symbol", "open_time", "high", "low", F.row_number().over(by_time()).alias("rn"))
    s = signals_.join(numbered.select("symbol", "open_time", F.col("rn").alias("s_rn")), ["symbol", "open_time"])
    s = s.withColumn("cell", F.explode(F.sequence(F.expr(f"cast((s_rn + 1) div {cell} as int)"), F.expr(f"cast((s_rn + {rows}) div {cell} as int)"))))
    part = numbered.select("symbol", F.expr(f"cast(rn div {cell} as int)").alias("cell"), "rn", "high", "low")
    seen = s.join(part, ["symbol", "cell"]).where(f"rn > s_rn AND rn <= s_rn + {rows}")
    long_ = F.col("side") == "long"
    sl = (long_ & (F.col("low") <= F.col("stop_loss"))) | (~long_ & (F.col("high") >= F.col("stop_loss")))
    tp = (long_ & (F.col("high") >= F.col("take_profit"))) | (~long_ & (F.col("low") <= F.col("take_profit")))
    found = seen.groupBy("symbol", "open_time", "side", "entry").agg(F.min(F.when(sl, F.col("rn"))).alias("sl_"), F.min(F.when(tp, F.col("rn"))).alias("tp_"), F.min("low").alias("lowest"), F.max("high").alias("highest"))
    against, with_ = F.when(long_, F.col("lowest")).otherwise(F.col("highest")), F.when(long_, F.col("highest")).otherwise(F.col("lowest"))
    way = F.when(long_, 1).otherwise(-1)
    percent = lambda x: F.greatest(F.lit(0.0), x / F.col("entry") * 100)
    return found.where("entry > 0").select(
        "symbol", "open_time", "side", F.when(F.col("tp_").isNotNull() & (F.col("sl_").isNull() | (F.col("tp_") < F.col("sl_"))), 1.0).otherwise(0.0).alias("would_trade_successful"),
        against.alias("optimal_sl"), with_.alias("optimal_tp"), percent(way * (F.col("entry") - against)).alias("optimal_sl_pct"), percent(way * (with_ - F.col("entry"))).alias("optimal_tp_pct"),
    )


def run_status(status_: DataFrame) -> DataFrame:
    """(status, n): how many symbols of a batch ended how; ``status_`` as of ``quality.status``."""
    return status_.groupBy("status").agg(F.count("*").alias("n"))


def aggregates(metrics_: DataFrame) -> DataFrame:
    """One row over the metrics of all symbols: how many, means, medians and sums; infinite values are left out of means."""
    known = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    out = [F.count("*").alias("n_symbols_in_batch")]
    out += [F.avg(known(c)).alias(f"mean_{c}") for c in ("win_rate", "total_return_pct", "total_pnl", "profit_factor", "n_trades", "avg_return_win_pct", "avg_return_loss_pct")]
    out += [F.median(known(c)).alias(f"median_{c}") for c in ("win_rate", "total_return_pct", "profit_factor")]
    return metrics_.agg(*out, F.sum(known("total_pnl")).alias("sum_total_pnl"), F.sum("n_trades").alias("sum_n_trades"))


def best_runs(metrics_: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` rows with the greatest profit factor, then profit: a top-n report."""
    return metrics_.orderBy(F.desc("profit_factor"), F.desc("total_pnl"), metrics_.columns[0]).limit(n)


def correlations(rows: DataFrame, features: list[str], target: str, least: int = 50, top: int | None = None) -> DataFrame:
    """(feature, pearson, n) over complete pairs, the greatest |pearson| first, the ``top`` ones or all.

    One aggregate over the rows for all features: counts, extremes and moments, merged as partial sums, so that one row a
    task is shuffled, however many features there are. A feature with fewer than ``least`` pairs is left out, and so is one
    that has one value, or the target one, over its pairs. Infinite values and NaN count as missing.
    """
    known = lambda c: F.when(F.abs(F.col(f"`{c}`").cast("double")) < float("inf"), F.col(f"`{c}`").cast("double"))
    wide = rows.select(known(target).alias("y"), *[known(c).alias(f"x{i}") for i, c in enumerate(features)])
    made = []
    for i, c in enumerate(features):
        x, y = F.when(F.col("y").isNotNull(), F.col(f"x{i}")), F.when(F.col(f"x{i}").isNotNull(), F.col("y"))
        made.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.covar_pop(f"x{i}", "y").alias("both"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("varies")))
    each = wide.agg(F.array(*made).alias("all")).select(F.inline("all")) if made else rows.sparkSession.createDataFrame([], "feature string, n long, both double, vx double, vy double, varies boolean")
    out = each.where((F.col("n") >= least) & F.col("varies")).select("feature", F.try_divide(F.col("both"), F.sqrt("vx") * F.sqrt("vy")).alias("pearson"), "n")
    out = out.where("pearson IS NOT NULL AND NOT isnan(pearson)").orderBy(F.desc(F.abs("pearson")), "feature")
    return out if top is None else out.limit(top)


def ranked(long: DataFrame, by: str, value: str, name: str, parts: int = 64) -> DataFrame:
    """``long`` with ``name``: the rank of ``value`` among the rows of its ``by``, ties sharing their mean rank.

    Values are cut at approximate quantiles (a small table of ``parts`` - 1 bounds for each ``by``, read once so that all
    steps see the same), so that one ``by`` is spread over tasks: rows before the part, plus the rank within it.
    """
    bounds = long.groupBy(by).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("bounds_")).collect()
    kind = long.schema[by].dataType.simpleString()
    cuts = long.sparkSession.createDataFrame([(r[0], [float(x) for x in r[1]]) for r in bounds], f"{by} {kind}, bounds_ array<double>")
    cut = long.join(F.broadcast(cuts), by).withColumn("part_", F.size(F.filter("bounds_", lambda x: x < F.col(value)))).drop("bounds_")
    sizes = cut.groupBy(by, "part_").agg(F.count("*").alias("size_"))
    before = sizes.select(by, "part_", (F.sum("size_").over(Window.partitionBy(by).orderBy("part_")) - F.col("size_")).alias("before_"))
    inside = Window.partitionBy(by, "part_")
    rank = F.rank().over(inside.orderBy(value)) + (F.count("*").over(Window.partitionBy(by, "part_", value)) - 1) / 2
    return cut.withColumn("rank_", rank).join(F.broadcast(before), [by, "part_"]).withColumn(name, F.col("before_") + F.col("rank_")).drop("part_", "rank_", "before_")


def spearman(rows: DataFrame, features: list[str], target: str, least: int = 50) -> DataFrame:
    """(feature, correlation, abs_correlation): rank correlations over complete pairs; features with fewer than ``least``
    pairs or one value are left out."""
    long = rows.select(F.col(target).cast("double").alias("y"), F.expr("stack({}, {}) AS (feature, x)".format(len(features), ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)))).where("x IS NOT NULL AND y IS NOT NULL")
    both = ranked(ranked(long, "feature", "x", "rx"), "feature", "y", "ry")
    spread = F.sqrt(F.var_pop("rx")) * F.sqrt(F.var_pop("ry"))
    varies = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    out = both.groupBy("feature").agg(F.try_divide(F.covar_pop("rx", "ry"), spread).alias("correlation"), F.count("*").alias("n"), varies.alias("varies"))
    out = out.where((F.col("n") >= least) & F.col("varies")).select("feature", "correlation", F.abs("correlation").alias("abs_correlation"))
    return out.orderBy(F.desc("abs_correlation"), "feature")


def parameter_runs(spark: SparkSession, options: dict[str, list]) -> DataFrame:
    """(run_id, one column each): every combination of ``options``, numbered with the last one turning fastest."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("run_id"))
    for name, values in options.items():
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("at_", name)).withColumn("run_id", F.col("run_id") * len(values) + F.col("at_")).drop("at_")
    return out


def first_touches(signals_: DataFrame, bars: DataFrame, stops: list[float], targets: list[float], hours: list[float], cell: int = 64) -> DataFrame:
    """Each of ``signals_`` (symbol, open_time, side, entry) with its row ``s_rn`` and the symbol's ``last_``, and for each of the
    ``stops`` and ``targets`` (shares of the entry) and ``hours`` the first later row that touches it: ``stop_{i}``,
    ``target_{i}``, ``time_{i}``, structs (rn, at, close) or null.

    The bars of the longest stay are looked at once for all of them, cut into cells so that the range is an equi-join.
    """
    numbered = bars.select("symbol", "open_time", "high", "low", "close", F.row_number().over(by_time()).alias("rn"))
    spot = F.struct("rn", F.col("open_time").alias("at"), "close")
    ends = numbered.groupBy("symbol").agg(F.max(spot).alias("last_"))
    s = signals_.join(numbered.select("symbol", "open_time", F.col("rn").alias("s_rn")), ["symbol", "open_time"]).join(ends, "symbol")
    due = until_due(s.withColumn("deadline", F.col("open_time") + int(max(hours) * 3_600_000)), numbered).drop("deadline").withColumn("to_rn", F.coalesce("t_rn", "last_.rn")).where("to_rn > s_rn")
    cells = due.withColumn("cell", F.explode(F.sequence(F.expr(f"cast((s_rn + 1) div {cell} as int)"), F.expr(f"cast(to_rn div {cell} as int)"))))
    part = numbered.select("symbol", F.expr(f"cast(rn div {cell} as int)").alias("cell"), "rn", F.col("open_time").alias("at"), "high", "low", "close")
    seen = cells.select("symbol", "open_time", "side", "entry", "s_rn", "to_rn", "cell").join(part, ["symbol", "cell"]).where("rn > s_rn AND rn <= to_rn")
    long_, entry = F.col("side") == "long", F.col("entry")
    spot = F.struct("rn", "at", "close")

    def least(hit: Column) -> Column:
        return F.min(F.when(hit, spot))

    made = {f"stop_{i}": least(F.when(long_, F.col("low") <= entry * (1 - x)).otherwise(F.col("high") >= entry * (1 + x))) for i, x in enumerate(stops)}
    made |= {f"target_{i}": least(F.when(long_, F.col("high") >= entry * (1 + x)).otherwise(F.col("low") <= entry * (1 - x))) for i, x in enumerate(targets)}
    made |= {f"time_{i}": least(F.col("at") >= F.col("open_time") + int(h * 3_600_000)) for i, h in enumerate(hours)}
    found = seen.groupBy("symbol", "open_time").agg(*[x.alias(c) for c, x in made.items()])
    return s.join(found, ["symbol", "open_time"], "left")


def grid_exits(touched: DataFrame, stops: list[float], targets: list[float], hours: list[float]) -> DataFrame:
    """Every stop with every target and stay: the rows of ``first_touches`` once for each, as ``exits`` gives them, with the
    numbers ``i_stop``, ``i_target`` and ``i_hours``. The stop goes before the target, both before the deadline."""
    long_, entry = F.col("side") == "long", F.col("entry")
    each = [F.struct(F.lit(i).alias("i_stop"), F.lit(j).alias("i_target"), F.lit(k).alias("i_hours"), F.lit(float(s)).alias("stop"), F.lit(float(t)).alias("target"), F.col(f"stop_{i}").alias("sl"), F.col(f"target_{j}").alias("tp"), F.col(f"time_{k}").alias("due")) for i, s in enumerate(stops) for j, t in enumerate(targets) for k in range(len(hours))]
    rest = [c for c in touched.columns if not c.startswith(("stop_", "target_", "time_"))]
    out = touched.select(*rest, F.inline(F.array(*each)))
    far = F.lit(2**31 - 1)
    sl, tp, due = (F.coalesce(F.col(f"{c}.rn"), far) for c in ("sl", "tp", "due"))
    stop = F.when(long_, entry * (1 - F.col("stop"))).otherwise(entry * (1 + F.col("stop")))
    target = F.when(long_, entry * (1 + F.col("target"))).otherwise(entry * (1 - F.col("target")))
    why = F.when((sl < far) & (sl <= tp) & (sl <= due), "sl").when((tp < far) & (tp <= due), "tp").when(due < far, "time").otherwise("eod")
    out = out.withColumns({"exit_reason": why, "stop_loss": stop, "take_profit": target})
    is_ = F.col("exit_reason")
    at = F.when(is_ == "sl", F.col("sl")).when(is_ == "tp", F.col("tp")).when(is_ == "time", F.col("due")).otherwise(F.col("last_"))
    price = F.when(is_ == "sl", F.col("stop_loss")).when(is_ == "tp", F.col("take_profit")).otherwise(at["close"])
    return out.withColumns({"exit_rn": at["rn"], "exit_time": at["at"], "exit_price": price}).drop("sl", "tp", "due", "last_", "stop", "target")


def grid(signals_: DataFrame, bars: DataFrame, runs: DataFrame, by: str, stops: list[float], targets: list[float], hours: list[float], capital: float = 10_000.0) -> DataFrame:
    """The measures of each of ``runs`` (run_id, ``by``, i_stop, i_target, i_hours): all symbols' trades of one run together,
    each symbol with its own capital. ``signals_``: (symbol, open_time, side, entry, ``by``).

    The run is a column: exits are found once for a signal, however many runs have it, and trades are those of each symbol and
    run. Runs without a trade have zeros. Falls are of the summed returns, symbol after symbol.
    """
    once = signals_.select("symbol", "open_time", "side", "entry").distinct()
    exited = grid_exits(first_touches(once, bars, stops, targets, hours), stops, targets, hours)
    of_run = F.broadcast(runs.select("run_id", by, "i_stop", "i_target", "i_hours"))  # as many rows as combinations
    each = signals_.select("symbol", "open_time", "side", by).join(of_run, by).join(exited, ["symbol", "open_time", "side", "i_stop", "i_target", "i_hours"])
    made = trades(each.withColumn("symbol", F.concat_ws("|", "run_id", "symbol")), capital)
    at = F.split("symbol", r"\|", 2)
    made = made.select(at[0].cast("long").alias("run_id"), at[1].alias("symbol"), "entry_time", "pnl", "pnl_pct")
    in_order = Window.partitionBy("run_id").orderBy("symbol", "entry_time").rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumn("sum_", F.sum("pnl_pct").over(in_order)).withColumn("fall_", F.max("sum_").over(in_order) - F.col("sum_"))
    gain, loss = F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(F.col("pnl") <= 0, F.col("pnl"))), F.lit(0.0)))
    found = made.groupBy("run_id").agg(F.count("*").alias("total_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), gain.alias("gross_profit"), loss.alias("gross_loss"), F.avg("pnl_pct").alias("avg_return_per_trade"), (F.avg("pnl_pct") / (F.stddev_pop("pnl_pct") + 1e-6)).alias("sharpe_ratio"), F.max("fall_").alias("max_drawdown"))
    found = found.withColumn("profit_factor", F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).otherwise(F.col("gross_profit")))
    return runs.join(found, "run_id", "left").fillna(0, [c for c in found.columns if c != "run_id"])
