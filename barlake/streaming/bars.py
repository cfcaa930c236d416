"""Bars and signals from a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlake.shipping import ship
from barlake.sources.bars import interval_minutes

_VALUES = ["open", "high", "low", "close", "volume"]


def stream_bars(ticks: DataFrame, interval: str, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks (ts, symbol, seq, price, size); late ticks change their bar until the watermark passes.

    In update mode a bar is sent whenever it changes; in append mode once it is closed.
    """
    at = F.struct("ts", "seq")
    w = F.window("ts", f"{interval_minutes(interval)} minutes")
    out = ticks.withWatermark("ts", late).groupBy("symbol", w).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return out.select("symbol", F.lit(interval).alias("interval"), F.unix_millis("window.start").alias("open_time"), "open", "high", "low", "close", "volume")


def distinct_alerts(signals: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (symbol, side, ts) alert once."""
    return signals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "side", "ts"])


def message() -> Column:
    """One line for an alert."""
    return F.format_string("%s %s at %s: stop %.4f, target %.4f", F.upper("symbol"), F.upper("side"), F.col("ts").cast("string"), "stop_loss", "take_profit")


def closed(bars: DataFrame, now_ms: Column | int) -> DataFrame:
    """Bars that have ended at ``now_ms``: the running one is left out."""
    width = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in width.items() for x in kv]), F.substring("interval", -1, 1))
    ms = F.regexp_extract("interval", r"^(\d+)", 1).cast("long") * unit
    return bars.where(F.col("open_time") + ms <= (F.lit(now_ms) if isinstance(now_ms, int) else now_ms))


def bounded_history(bars: DataFrame, rows: int) -> DataFrame:
    """Of a stream of bars: the last ``rows`` bars of each symbol and interval that a batch changed (update mode).

    The history is the state: a bar that comes again replaces the one before it, older ones than the last ``rows`` go. Bars
    without a time or a close are left out, so that one symbol's broken bars stop neither it nor the others.
    """
    ship(bars.sparkSession)
    columns = ["open_time", *_VALUES]

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(columns, state.get, strict=True))) if state.exists else pd.DataFrame(columns=columns)
        for part in parts:
            good = part.loc[part["open_time"].notna() & part["close"].notna(), columns]
            both = pd.concat([held, good]) if len(held) else good
            held = both.drop_duplicates("open_time", keep="last").sort_values("open_time").tail(rows)
        if len(held):
            state.update(tuple(held[c].tolist() for c in columns))
            yield held.assign(symbol=key[0], interval=key[1])[["symbol", "interval", *columns]]

    of_state = ", ".join(["open_time array<long>", *[f"{c} array<double>" for c in _VALUES]])
    out = ", ".join(["symbol string, interval string, open_time long", *[f"{c} double" for c in _VALUES]])
    return bars.groupBy("symbol", "interval").applyInPandasWithState(keep, out, of_state, "update", GroupStateTimeout.NoTimeout)
