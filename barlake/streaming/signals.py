"""The strategy's signals from a stream of bars: the rows that the batch has, each once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlake.functions.supertrend import strategy_step
from barlake.shipping import ship
from barlake.sources.bars import interval_minutes

_BAR = ["open_time", "rank", "open", "high", "low", "close"]
_STATE = "done long, moves array<double>, ema array<double>, trend array<double>, before array<double>, m_high array<double>, m_low array<double>, open_time array<long>, rank array<long>, open array<double>, high array<double>, low array<double>, close array<double>"
_OUT = "symbol string, open_time long, side string, entry double, stop_loss double, take_profit double, deadline long"


def _decider(span: int, swing: int, rsi_long: float, rsi_short: float, st: tuple[int, float], period: int = 14) -> Callable[..., str | None]:
    """``decide(carry, bar, mid, high)``: long, short or None for the next bar of a symbol; ``carry`` holds lists that the
    bars before left and that are changed in place, of at most ``swing`` numbers."""
    trend_step = strategy_step(*st)

    def decide(carry: dict[str, list], bar: tuple, mid: tuple, high: tuple) -> str | None:
        O, H, L, C = bar
        before, moves = carry["before"], carry["moves"]
        if before:
            now = [max(C - before[1], 0.0), max(before[1] - C, 0.0)]
            moves[:] = [(1 - 1 / period) * y + x / period for y, x in zip(moves, now, strict=True)] if moves else now
        rsi = 100 - 100 / (1 + moves[0] / moves[1]) if moves and moves[1] else 50.0
        ema = carry["ema"]
        ema[:] = [(1 - 2 / (span + 1)) * ema[0] + 2 / (span + 1) * high[2]] if ema else [high[2]]
        trend, _, way = trend_step(tuple(carry["trend"]) or None, *high)
        carry["trend"][:] = map(float, trend)
        for name, x in (("m_high", mid[0]), ("m_low", mid[1])):
            carry[name][:] = [*carry[name], x][-swing:]
        body, rng, up, low = abs(C - O), H - L, H - max(O, C), min(O, C) - L
        o1, c1 = before or (None, None)
        small, ranged = 0 < body <= 0.35 * rng, rng > 0
        bull = (before and c1 < o1 and C > O and C > o1 and O < c1) or (small and low >= 2 * body and up <= body) or (low >= 2 * body and up <= 0.6 * body and ranged)
        bear = (before and c1 > o1 and C < O and C < o1 and O > c1) or (small and up >= 2 * body and low <= body) or (up >= 2 * body and low <= 0.6 * body and ranged)
        before[:] = [O, C]
        top, bottom = max(carry["m_high"]), min(carry["m_low"])
        width = top - bottom
        if len(carry["m_high"]) < swing // 2 or not width:
            return None
        if high[2] > ema[0] and way == 1 and top - 0.786 * width <= mid[2] <= top - 0.618 * width and bull and rsi <= rsi_long:
            return "long"
        if high[2] < ema[0] and way == -1 and bottom + 0.618 * width <= mid[2] <= bottom + 0.786 * width and bear and rsi >= rsi_short:
            return "short"
        return None

    return decide


def _longer(bars: pd.DataFrame, width: int) -> list[tuple]:
    """(high, low, close) of the bar of ``width`` ms that each of the sorted ``bars`` lies in."""
    of = bars.groupby(bars["open_time"] // width)
    return list(zip(of["high"].transform("max"), of["low"].transform("min"), of["close"].transform("last"), strict=True))


def stream_signals(
    bars: DataFrame, late: str = "1 hour", order: str | None = None, span: int = 200, swing: int = 64, rsi_long: float = 42, rsi_short: float = 60,
    st: tuple[int, float] = (10, 3.0), stop: float = 0.035, target: float = 0.065, hours: float = 96, mid: str = "1h", high: str = "4h",
) -> DataFrame:
    """Signals of a stream of base bars (symbol, open_time, open, high, low, close), as ``signals(setups(...))`` has them when
    the middle and high bars are made of the base ones. Append mode; each signal is sent once.

    A base row looks at the whole high bar that it lies in, as in the batch. So bars wait in the state until the watermark
    (``late`` behind the newest bar) passes the end of their high bar, by data or by an event-time timer, and are then decided
    in order. Until then a bar that comes again replaces the one before it: the one with the greater ``order``, a long column,
    where it is given; else that of the later batch, and in one batch the greatest by its prices. Bars that come later still
    are dropped. Bars without a symbol, a time or a price are left out.

    A symbol's state: two moves of RSI, an average, the five numbers of Supertrend, the bar before, ``swing`` highs and lows,
    and the bars that wait, which are those of ``late`` and one high bar.
    """
    ship(bars.sparkSession)
    middle, block = interval_minutes(mid) * 60_000, interval_minutes(high) * 60_000
    decide = _decider(span, swing, rsi_long, rsi_short, st)
    names = ["moves", "ema", "trend", "before", "m_high", "m_low"]

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, *held = state.get if state.exists else (-(1 << 62), *[[] for _ in range(len(names) + len(_BAR))])
        carry = {k: list(x) for k, x in zip(names, held, strict=False)}
        waiting = pd.DataFrame({c: pd.Series(list(x), dtype="int64" if c in _BAR[:2] else "float64") for c, x in zip(_BAR, held[len(names) :], strict=True)})
        came = [p[_BAR] for p in parts if len(p)]
        if came:
            fresh = pd.concat(came).sort_values(_BAR)
            waiting = pd.concat([waiting, fresh]).sort_values(["open_time", "rank"], kind="stable").drop_duplicates("open_time", keep="last")
        ends = (waiting["open_time"] // block + 1) * block
        passed = state.getCurrentWatermarkMs()
        ready, waiting = waiting[(ends > done) & (ends <= passed)], waiting[ends > max(done, passed)]
        found = []
        if len(ready):
            done = int(ends[ends <= passed].max())
            for bar, m, h in zip(ready[_BAR].itertuples(index=False), _longer(ready, middle), _longer(ready, block), strict=True):
                side = decide(carry, tuple(bar)[2:], m, h)
                if side:
                    way, entry = (1 if side == "long" else -1), bar.close
                    found.append((key[0], bar.open_time, side, entry, entry * (1 - way * stop), entry * (1 + way * target), bar.open_time + int(hours * 3_600_000)))
        state.update((done, *[carry[k] for k in names], *[waiting[c].tolist() for c in _BAR]))
        if len(waiting):
            state.setTimeoutTimestamp(int(waiting["open_time"].min() // block + 1) * block)
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in _OUT.split(", ")])

    rank = F.coalesce(F.col(order).cast("long"), F.lit(0)) if order else F.lit(0)
    asked = bars.select("symbol", F.timestamp_millis("open_time").alias("ts_"), F.col("open_time").cast("long").alias("open_time"), rank.cast("long").alias("rank"), *[F.col(c).cast("double").alias(c) for c in _BAR[2:]])
    whole = asked.dropna().withWatermark("ts_", late)
    return whole.groupBy("symbol").applyInPandasWithState(keep, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
