"""Regimes and forward-looking targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.windows import back, by_time, flag

from .align import asof


def percentile_rank(x: Column, n: int = 100) -> Column:
    """Share of the last ``n`` values that are at most this one; null if it is null or below max(15, n / 5) values."""
    held = F.collect_list(x).over(back(n))
    return F.when((F.size(held) >= max(15, n // 5)) & x.isNotNull(), F.size(F.filter(held, lambda v: v <= x)) / F.size(held))


def composite(adx: Column, rank: Column) -> Column:
    """0 quiet, 1 ranging, 2 trending, 3 volatile; null where ADX or the volatility rank is unknown."""
    return F.when(rank.isNull() | adx.isNull(), None).when(rank >= 0.75, 3).when(adx > 25, 2).when(adx < 20, 1).when(rank <= 0.25, 0).otherwise(1)


def regime(bars: DataFrame, adx: str = "adx_14", atr: str = "atr_14", n: int = 100) -> DataFrame:
    """``regime``: 0 quiet, 1 ranging, 2 trending, 3 volatile; null where ADX or the volatility rank is unknown. The flags
    look at ADX (over 25, below 20) and at the rank (from 0.75) each by itself."""
    out = bars.withColumn("volatility_regime", percentile_rank(F.col(atr), n))
    p, a = F.col("volatility_regime"), F.col(adx)
    return out.withColumns({"trend_strength": a, "regime": composite(a, p), "regime_trending": flag(a > 25), "regime_ranging": flag(a < 20), "regime_volatile": flag(p >= 0.75)})


def regimes(frames: dict[str, DataFrame], n: int = 100) -> DataFrame:
    """The base bars (the first of ``frames``, interval: bars with adx_14 and atr_14) with their flags and ``regime_{interval}``
    of every interval; longer bars are taken as of each base row, and ranked over base rows."""
    base, *rest = frames
    out = regime(frames[base], n=n).withColumnRenamed("regime", f"regime_{base}")
    for name in rest:
        out = asof(out, frames[name].select("symbol", "open_time", F.col("adx_14").alias("a_"), F.col("atr_14").alias("v_")))
        found = regime(out.select("symbol", "open_time", "a_", "v_"), "a_", "v_", n).select("symbol", "open_time", F.col("regime").alias(f"regime_{name}"))
        out = out.drop("a_", "v_").join(found, ["symbol", "open_time"])
    return out


def targets(bars: DataFrame, minutes: int, horizons: dict[str, tuple[int, float]] | None = None) -> DataFrame:
    """Forward returns in %, whether they exceed a bound, and the class of the last horizon (beyond 1 % either way)."""
    C = F.col("close")
    horizons = horizons or {"1h": (1, 0.5), "4h": (4, 1.0), "1d": (24, 2.0)}
    out = {}
    for name, (hours, bound) in horizons.items():
        k = max(1, round(60 * hours / minutes))
        r = (F.try_divide(F.lead(C, k).over(by_time()), C) - 1) * 100
        out |= {f"target_{name}_return": r, f"target_up_{name}": F.when(r.isNotNull(), (r > bound).cast("double")), "target_class": F.when(r.isNotNull(), F.when(r > 1, 1).when(r < -1, -1).otherwise(0))}
    return bars.withColumns(out)


def legacy_targets(bars: DataFrame, steps: tuple[int, ...] = (1, 4, 16, 96)) -> DataFrame:
    """Log returns over ``steps`` rows ahead, and the sign of the change."""
    C = F.col("close")
    out = {}
    for k in steps:
        ahead = F.lead(C, k).over(by_time())
        ratio = F.try_divide(ahead, C)
        out |= {f"target_fwd_ret_{k}": F.when(ratio > 0, F.ln(ratio)), f"target_dir_{k}": F.signum(ahead - C)}
    return bars.withColumns(out)


def simple_targets(bars: DataFrame, steps: tuple[int, ...] = (1, 4), least: float = 0.005) -> DataFrame:
    """Simple returns over ``steps`` rows ahead, and 1, -1 or 0 as the change is beyond ``least`` of the close or within."""
    C = F.col("close")
    out = {}
    for k in steps:
        change = F.lead(C, k).over(by_time()) - C
        out |= {f"target_fwd_ret_{k}": F.try_divide(change, C), f"target_dir_{k}": F.when(change > least * C, 1.0).when(change < -least * C, -1.0).when(change.isNotNull(), 0.0)}
    return bars.withColumns(out)


def risk_adjusted(bars: DataFrame, steps: int, atr: str = "atr_14") -> Column:
    """Forward simple return over ``steps`` rows, divided by ATR."""
    C = F.col("close")
    return F.try_divide(F.try_divide(F.lead(C, steps).over(by_time()) - C, C), F.col(atr))
