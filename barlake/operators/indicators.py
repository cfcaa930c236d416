"""Technical indicators. Division by zero gives null; averages need their full number of rows unless said otherwise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.carry import Arrays, average, carried, poc, ratio
from barlake.functions.supertrend import feature_step, strategy_step
from barlake.functions.walk import walk
from barlake.functions.windows import back, by_time, ewm, rolling, so_far


def previous(x: Column | str, k: int = 1) -> Column:
    return F.lag(x, k).over(by_time())


def true_range() -> Column:
    """high - low, or the distance of either to the close before, whichever is greatest."""
    H, L, C = (F.col(c) for c in ("high", "low", "close"))
    return F.greatest(H - L, F.abs(H - previous(C)), F.abs(L - previous(C)))


def sma(x: Column, n: int) -> Column:
    return rolling(F.avg(x), x, n, n)


def ema(bars: DataFrame, spans: list[int], column: str = "close") -> DataFrame:
    """``ema_{span}`` of ``column``, alpha = 2 / (span + 1), from the first row on."""
    return ewm(bars, {f"ema_{n}": (column, 2 / (n + 1), 1) for n in spans})


def atr(bars: DataFrame, periods: list[int]) -> DataFrame:
    """``atr_{p}``: Wilder's average of the true range."""
    return ewm(bars.withColumn("tr_", true_range()), {f"atr_{p}": ("tr_", 1 / p, p) for p in periods}).drop("tr_")


def rsi(bars: DataFrame, periods: list[int]) -> DataFrame:
    """``rsi_{p}`` by Wilder's averages of gains and losses; null while there is no loss."""
    C = F.col("close")
    change = C - previous(C)
    moved = bars.withColumns({"gain_": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "loss_": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))})
    out = ewm(moved, {f"{k}_{p}": (f"{k}_", 1 / p, p) for p in periods for k in ("gain", "loss")})
    return out.withColumns({f"rsi_{p}": 100 - 100 / (1 + F.try_divide(f"gain_{p}", f"loss_{p}")) for p in periods}).select(*bars.columns, *[f"rsi_{p}" for p in periods])


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    out = ewm(bars, {"fast_": ("close", 2 / (fast + 1), 1), "slow_": ("close", 2 / (slow + 1), 1)}).withColumn("macd", F.col("fast_") - F.col("slow_"))
    out = ewm(out, {"macd_signal": ("macd", 2 / (signal + 1), 1)})
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("fast_", "slow_")


def adx(bars: DataFrame, p: int = 14) -> DataFrame:
    """``adx``, ``di_plus`` and ``di_minus`` of period p; an undefined DX counts as 0, also before the averages start."""
    H, L = (F.col(c) for c in ("high", "low"))
    up, down = H - previous(H), previous(L) - L
    moved = bars.withColumns({"up_": F.when(up.isNull(), 0.0).when((up > down) & (up > 0), up).otherwise(0.0), "down_": F.when(down.isNull(), 0.0).when((down > up) & (down > 0), down).otherwise(0.0), "tr_": true_range()})
    out = ewm(moved, {"a_": ("tr_", 1 / p, p), "u_": ("up_", 1 / p, p), "d_": ("down_", 1 / p, p)})
    out = out.withColumns({f"di_plus_{p}": 100 * F.try_divide("u_", "a_"), f"di_minus_{p}": 100 * F.try_divide("d_", "a_")})
    plus, minus = F.col(f"di_plus_{p}"), F.col(f"di_minus_{p}")
    out = out.withColumn("dx_", F.coalesce(100 * F.try_divide(F.abs(plus - minus), plus + minus), F.lit(0.0)))
    return ewm(out, {f"adx_{p}": ("dx_", 1 / p, p)}).drop("up_", "down_", "tr_", "a_", "u_", "d_", "dx_")


def keltner(bars: DataFrame, span: int = 20, period: int = 20, times: float = 1.5) -> DataFrame:
    out = ewm(bars.withColumn("tr_", true_range()), {"keltner_mid": ("close", 2 / (span + 1), 1), "a_": ("tr_", 1 / period, period)})
    return out.withColumns({"keltner_upper": F.col("keltner_mid") + times * F.col("a_"), "keltner_lower": F.col("keltner_mid") - times * F.col("a_")}).drop("tr_", "a_")


def bollinger(bars: DataFrame, n: int = 20, times: float = 2.0) -> DataFrame:
    C = F.col("close")
    mid, sd = sma(C, n), rolling(F.stddev_samp(C), C, n, n)
    out = bars.withColumns({"bb_mid": mid, "sd_": sd}).withColumns({"bb_upper": F.col("bb_mid") + times * F.col("sd_"), "bb_lower": F.col("bb_mid") - times * F.col("sd_")})
    span = F.col("bb_upper") - F.col("bb_lower")
    return out.withColumns({"bb_pct_b": F.try_divide(C - F.col("bb_lower"), span), "bb_bandwidth": F.try_divide(span, "bb_mid")}).drop("sd_")


def stochastic(bars: DataFrame, k: int = 14, smooth: int = 3, d: int = 3) -> DataFrame:
    """Slow stochastic: ``stoch_k`` is %K smoothed, ``stoch_d`` its average."""
    H, L, C = (F.col(c) for c in ("high", "low", "close"))
    low, high = rolling(F.min(L), L, k, k), rolling(F.max(H), H, k, k)
    out = bars.withColumn("fast_", 100 * F.try_divide(C - low, high - low))
    out = out.withColumn("stoch_k", rolling(F.avg("fast_"), F.col("fast_"), smooth, smooth))
    return out.withColumn("stoch_d", rolling(F.avg("stoch_k"), F.col("stoch_k"), d, d)).drop("fast_")


def williams_r(n: int = 14) -> Column:
    H, L, C = (F.col(c) for c in ("high", "low", "close"))
    low, high = rolling(F.min(L), L, n, n), rolling(F.max(H), H, n, n)
    return -100 * F.try_divide(high - C, high - low)


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """``cci_{n}`` with the mean absolute deviation of the window around its own mean."""
    H, L, C = (F.col(c) for c in ("high", "low", "close"))
    typical = (H + L + C) / 3
    out = bars.withColumn("tp_", typical)
    out = out.withColumns({"mean_": sma(F.col("tp_"), n), "all_": F.collect_list("tp_").over(back(n))})
    apart = F.aggregate("all_", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("mean_"))) / n
    return out.withColumn(f"cci_{n}", F.try_divide(F.col("tp_") - F.col("mean_"), 0.015 * apart)).drop("tp_", "mean_", "all_")


def obv() -> Column:
    """Sum so far of the volume with the sign of the close's change; the first row counts 0."""
    C, V = (F.col(c) for c in ("close", "volume"))
    raise_ = F.signum(C - F.col("before_")) * V
    return F.sum(F.coalesce(raise_, F.lit(0.0))).over(so_far())


def volume_bundle(bars: DataFrame, window: int | None = None) -> DataFrame:
    """obv, vwap (so far, or of ``window`` rows) and mean volumes."""
    H, L, C, V = (F.col(c) for c in ("high", "low", "close", "volume"))
    w = back(window) if window else so_far()
    typical = (H + L + C) / 3
    out = bars.withColumn("before_", previous(C)).withColumn("obv", obv())
    return out.withColumns({"vwap": F.try_divide(F.sum(typical * V).over(w), F.sum(V).over(w)), "volume_sma_20": sma(V, 20), "volume_sma_50": sma(V, 50)}).drop("before_")


def volume_poc(bars: DataFrame, window: int = 96, bins: int = 24) -> DataFrame:
    """``bars`` with ``vp_poc``: middle of the price bin with the most volume in the window, the lowest at a tie; the mean if
    the window is flat; null before it is full."""

    def step(state: dict | None, x: Arrays) -> tuple[dict, Arrays]:
        tail, found = poc((state or {}).get("tail"), (x["high"] + x["low"] + x["close"]) / 3, x["volume"], window, bins)
        return {"tail": tail}, {"vp_poc": found}

    return carried(bars, ["high", "low", "close", "volume"], ["vp_poc"], step)


def supertrend(bars: DataFrame, period: int = 10, times: float = 3.0) -> DataFrame:
    """(symbol, open_time, supertrend, supertrend_dir), as the strategy uses it."""
    rows = bars.select("symbol", "open_time", "high", "low", "close")
    return walk(rows, "open_time", ["high", "low", "close"], lambda: None, strategy_step(period, times), {"supertrend": "double", "supertrend_dir": "long"}).drop("high", "low", "close")


def feature_supertrend(bars: DataFrame, period: int = 10, times: float = 3.0, intended: bool = False) -> DataFrame:
    """(symbol, open_time, supertrend, supertrend_direction), as a feature; see ``feature_step``."""
    rows = atr(bars, [period]).select("symbol", "open_time", "high", "low", "close", F.col(f"atr_{period}").alias("atr_"))
    return walk(rows, "open_time", ["high", "low", "close", "atr_"], lambda: None, feature_step(times, intended), {"supertrend": "double", "supertrend_direction": "long"}).drop("high", "low", "close", "atr_")


def stochastic_fast(bars: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    """``stochf_k`` is the raw %K, ``stochf_d`` its average."""
    H, L, C = (F.col(c) for c in ("high", "low", "close"))
    low, high = rolling(F.min(L), L, k, k), rolling(F.max(H), H, k, k)
    out = bars.withColumn("stochf_k", 100 * F.try_divide(C - low, high - low))
    return out.withColumn("stochf_d", rolling(F.avg("stochf_k"), F.col("stochf_k"), d, d))


#: Columns of ``technical``, in order.
TECHNICAL = [
    *[f"ema_{n}" for n in (20, 50, 100, 200)], *[f"sma_{n}" for n in (20, 50, 200)], "macd", "macd_signal", "macd_hist", "adx_14", "di_plus_14", "di_minus_14",
    "supertrend_p3_m10_0", "supertrend_direction_p3_m10_0", "supertrend_p5_m20_0", "supertrend_direction_p5_m20_0", *[f"rsi_{p}" for p in (7, 14, 21)],
    "stoch_k_14_3", "stoch_d_14_3_3", "williams_r_14", "cci_20", "bb_mid", "bb_upper", "bb_lower", "bb_pct_b", "bb_bandwidth", *[f"atr_{p}" for p in (7, 14, 21)],
    "keltner_mid", "keltner_upper", "keltner_lower", "obv", "volume_sma_20", "volume_sma_50", "vp_poc",
]
_CARRIED = [*[f"ema_{n}" for n in (20, 50, 100, 200)], "macd", "macd_signal", "adx_14", "di_plus_14", "di_minus_14", *[f"rsi_{p}" for p in (7, 14, 21)], *[f"atr_{p}" for p in (7, 14, 20, 21)], "obv", "vp_poc"]


def _technical_step(window: int, bins: int):
    """A step of ``carried`` for all that looks back without end, and for the volume profile."""

    def step(state: dict | None, x: Arrays) -> tuple[dict, Arrays]:
        was, now, out = state or {}, {}, {}
        H, L, C, V = (x[c] for c in ("high", "low", "close", "volume"))
        h, lo, c = (np.concatenate([[was.get(k, np.nan)], a[:-1]]) for k, a in (("high", H), ("low", L), ("close", C)))
        now |= {"high": H[-1], "low": L[-1], "close": C[-1]}

        def mean(name: str, values: np.ndarray, alpha: float, least: int = 1) -> np.ndarray:
            now[name], y = average(was.get(name), values, alpha, least)
            return y

        wide = np.fmax(H - L, np.fmax(np.abs(H - c), np.abs(L - c)))
        gain, loss, up, down = C - c, c - C, H - h, lo - L
        out |= {f"ema_{n}": mean(f"ema_{n}", C, 2 / (n + 1)) for n in (20, 50, 100, 200)} | {f"atr_{p}": mean(f"atr_{p}", wide, 1 / p, p) for p in (7, 14, 20, 21)}
        for p in (7, 14, 21):
            out[f"rsi_{p}"] = 100 - 100 / (1 + ratio(mean(f"gain_{p}", np.maximum(gain, 0), 1 / p, p), mean(f"loss_{p}", np.maximum(loss, 0), 1 / p, p)))
        out["macd"] = mean("ema_12", C, 2 / 13) - mean("ema_26", C, 2 / 27)
        out["macd_signal"] = mean("macd_signal", out["macd"], 0.2)
        rise, fall = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        plus, minus = (100 * ratio(mean(k, m, 1 / 14, 14), out["atr_14"]) for k, m in (("rise", rise), ("fall", fall)))
        out |= {"di_plus_14": plus, "di_minus_14": minus, "adx_14": mean("adx", np.nan_to_num(100 * ratio(np.abs(plus - minus), plus + minus)), 1 / 14, 14)}
        moved = np.nan_to_num(np.sign(C - c) * V)
        out["obv"] = was.get("obv", 0.0) + np.cumsum(moved)
        now["obv"] = out["obv"][-1]
        now["tail"], out["vp_poc"] = poc(was.get("tail"), (H + L + C) / 3, V, window, bins)
        return now, out

    return step


def technical(bars: DataFrame, vp_window: int = 96, vp_bins: int = 24) -> DataFrame:
    """``bars`` with the columns of ``TECHNICAL``.

    What looks back without end is made of arrays in one pass, the rest by windows of rows. Both Supertrends start from an
    unknown ATR, so that, as known results have it, they have no line and the way 0; ``feature_supertrend`` has lines.
    """
    C, V = F.col("close"), F.col("volume")
    out = carried(bars, ["high", "low", "close", "volume"], _CARRIED, _technical_step(vp_window, vp_bins))
    out = out.withColumns({"macd_hist": F.col("macd") - F.col("macd_signal"), "keltner_mid": F.col("ema_20"), "keltner_upper": F.col("ema_20") + 1.5 * F.col("atr_20"), "keltner_lower": F.col("ema_20") - 1.5 * F.col("atr_20")})
    out = out.withColumns({**{f"sma_{n}": sma(C, n) for n in (20, 50, 200)}, **{f"volume_sma_{n}": sma(V, n) for n in (20, 50)}, "williams_r_14": williams_r()})
    out = bollinger(cci(stochastic(out))).withColumnsRenamed({"stoch_k": "stoch_k_14_3", "stoch_d": "stoch_d_14_3_3"})
    none = {f"supertrend_{p}": F.lit(None).cast("double") for p in ("p3_m10_0", "p5_m20_0")} | {f"supertrend_direction_{p}": F.lit(0).cast("tinyint") for p in ("p3_m10_0", "p5_m20_0")}
    return out.withColumns(none).select(*bars.columns, *TECHNICAL)


def bundle(bars: DataFrame) -> DataFrame:
    """All indicators of one interval but Supertrend and the volume profile, and vwap."""
    out = volume_bundle(technical(bars).drop("volume_sma_20", "volume_sma_50", "obv")).withColumnsRenamed({"stoch_k_14_3": "stoch_k", "stoch_d_14_3_3": "stoch_d"})
    return out.drop("vp_poc", *[c for c in TECHNICAL if c.startswith("supertrend")])


def trend(bars: DataFrame, spans: tuple[int, ...] = (12, 26, 50, 200), lines: tuple[tuple[int, float], ...] = ((10, 3.0),)) -> DataFrame:
    """Averages, MACD, ADX and DMI (``adx``, ``plus_di``, ``minus_di``), and a Supertrend for each (period, factor), which has
    no line, as in ``technical``."""
    out = adx(macd(ema(bars, list(spans)))).withColumnsRenamed({"adx_14": "adx", "di_plus_14": "plus_di", "di_minus_14": "minus_di"})
    for p, m in lines:
        name = f"p{p}_m{float(m)}".replace(".", "_")
        out = out.withColumns({f"supertrend_{name}": F.lit(None).cast("double"), f"supertrend_direction_{name}": F.lit(0).cast("tinyint")})
    return out


def momentum(bars: DataFrame, periods: tuple[int, ...] = (7, 14, 21), k: int = 14, d: int = 3, ranges: tuple[int, ...] = (14, 28)) -> DataFrame:
    """RSI, the stochastic (raw %K and its average) and Williams %R of several periods."""
    out = stochastic_fast(rsi(bars, list(periods)), k, d).withColumnsRenamed({"stochf_k": "stoch_k", "stochf_d": "stoch_d"})
    return out.withColumns({f"williams_r_{n}": williams_r(n) for n in ranges})


def volatility(bars: DataFrame, n: int = 20, times: float = 2.0, periods: tuple[int, ...] = (14, 21)) -> DataFrame:
    """Bollinger bands, ATR of several periods, and a Keltner channel of span 20, ATR 10 and factor 2."""
    return keltner(atr(bollinger(bars, n, times), list(periods)), 20, 10, 2.0)


def volumes(bars: DataFrame, window: int | None = None, vp_window: int = 96, vp_bins: int = 24) -> DataFrame:
    """obv, vwap (so far, or of ``window`` rows) and vp_poc."""
    return volume_poc(volume_bundle(bars, window).drop("volume_sma_20", "volume_sma_50"), vp_window, vp_bins)
