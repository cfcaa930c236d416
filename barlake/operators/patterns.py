"""Price action: candle patterns, swings, fair value gaps; and structure: sweeps, order blocks, breaks, Fibonacci zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.windows import among, back, by_time, flag, last_where, rolling

from .indicators import atr, previous


def with_atr(bars: DataFrame) -> DataFrame:
    """``bars`` with ``atr_14``, made unless it is there."""
    return bars if "atr_14" in bars.columns else atr(bars, [14])


def by_atr(x: Column) -> Column:
    """``x`` in average true ranges; null unless ATR is above zero."""
    return x / F.when(F.col("atr_14") > 0, F.col("atr_14"))


def candles(bars: DataFrame, intended: bool = False) -> DataFrame:
    """Ten pattern flags. ``intended``: engulfing also needs the larger body; else the body test compares a flag, as known
    results do."""
    O, H, L, C = (F.col(c) for c in ("open", "high", "low", "close"))
    body, rng = F.abs(C - O), F.nullif(H - L, F.lit(0.0))
    up, low = H - F.greatest(O, C), F.least(O, C) - L
    share = F.try_divide(body, rng)
    out = bars.withColumns({"share_": share, "o1_": previous(O), "c1_": previous(C), "o2_": previous(O, 2), "c2_": previous(C, 2)})
    out = out.withColumns({"s1_": previous("share_"), "s2_": previous("share_", 2)})
    o1, c1, o2, c2, s, s1, s2 = (F.col(k) for k in ("o1_", "c1_", "o2_", "c2_", "share_", "s1_", "s2_"))
    bull, bear = (c1 < o1) & (C > O) & (O <= c1) & (C >= o1), (c1 > o1) & (C < O) & (O >= c1) & (C <= o1)
    if intended:
        engulf = bull & (C - O > o1 - c1), bear & (O - C > c1 - o1)
    else:
        engulf = flag(bull).cast("double") > o1 - c1, flag(bear).cast("double") > c1 - o1
    long_ = 0.55 * 0.85
    return out.withColumns({
        "pat_doji": flag(s <= 0.1), "pat_hammer": flag((low >= 2 * body) & (up <= 1.05 * body) & (rng > 0) & (low >= 0.5 * rng)),
        "pat_shooting_star": flag((up >= 2 * body) & (low <= 1.05 * body) & (rng > 0) & (C < O) & (up >= 0.6 * rng)),
        "pat_bull_engulfing": flag(engulf[0]), "pat_bear_engulfing": flag(engulf[1]),
        "pat_morning_star": flag((c2 < o2) & (s2 >= 0.55) & (s1 <= 0.35) & (C > O) & (C > (o2 + c2) / 2)),
        "pat_evening_star": flag((c2 > o2) & (s2 >= 0.55) & (s1 <= 0.35) & (C < O) & (C < (o2 + c2) / 2)),
        "pat_three_white_soldiers": flag((C > O) & (c1 > o1) & (c2 > o2) & (C > c1) & (c1 > c2) & (s >= long_) & (s1 >= long_) & (s2 >= long_)),
        "pat_three_black_crows": flag((C < O) & (c1 < o1) & (c2 < o2) & (C < c1) & (c1 < c2) & (s >= long_) & (s1 >= long_) & (s2 >= long_)),
        "pat_pin_bar": flag(((low >= 0.6 * rng) | (up >= 0.6 * rng)) & (s <= 0.35)),
    }).drop("share_", "o1_", "c1_", "o2_", "c2_", "s1_", "s2_")


def swing_flags(bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """``is_swing_high`` and ``is_swing_low``: strictly beyond ``left`` rows before and ``right`` after, all of which exist."""
    H, L = (F.col(c) for c in ("high", "low"))
    w = by_time()
    near = [F.lag for _ in range(left)], [F.lead for _ in range(right)]
    high = low = F.lit(True)
    for shift, count in ((near[0], left), (near[1], right)):
        for k in range(1, count + 1):
            high = high & (H > shift[0](H, k).over(w))
            low = low & (L < shift[0](L, k).over(w))
    return bars.withColumns({"is_swing_high": flag(high), "is_swing_low": flag(low)})


def swings(bars: DataFrame) -> DataFrame:
    """Swing flags and rows since each, under both names they go by, and how far (in %) the last swing high is above the close."""
    H, C = (F.col(c) for c in ("high", "close"))
    out = swing_flags(bars).withColumn("rn_", F.row_number().over(by_time()))
    last = last_where(F.col("is_swing_high") == 1, H)
    return out.withColumns({
        "bars_since_swing_high": F.col("rn_") - last_where(F.col("is_swing_high") == 1, F.col("rn_")),
        "bars_since_swing_low": F.col("rn_") - last_where(F.col("is_swing_low") == 1, F.col("rn_")),
        "swing_high_distance_pct": F.when(last > C, F.try_divide(last - C, C) * 100),
    }).withColumns({"swing_is_high": F.col("is_swing_high"), "swing_is_low": F.col("is_swing_low"), "swing_bars_since_high": F.col("bars_since_swing_high"), "swing_bars_since_low": F.col("bars_since_swing_low")}).drop("rn_")


def support_resistance(bars: DataFrame, keep: int = 30, at_level: float = 0.25) -> DataFrame:
    """Nearest of the last ``keep`` swing lows below, and swing highs above, the close; distances, also in % and in ATR;
    whether the close is within ``at_level`` ATR of them; touches within 0.1 %."""
    H, L, C = (F.col(c) for c in ("high", "low", "close"))
    out = swing_flags(with_atr(bars))
    for kind, price in (("low", L), ("high", H)):
        swing = F.col(f"is_swing_{kind}") == 1
        out = out.withColumn(f"{kind}s_", F.when(swing, F.collect_list(price).over(among(f"is_swing_{kind}").rowsBetween(1 - keep, 0))))
        out = out.withColumn(f"{kind}s_", last_where(swing, F.col(f"{kind}s_")))
    out = out.withColumns({"sr_nearest_support": F.array_max(F.filter("lows_", lambda p: p < C)), "sr_nearest_resistance": F.array_min(F.filter("highs_", lambda p: p > C))})
    s, r = F.col("sr_nearest_support"), F.col("sr_nearest_resistance")

    def touches(level: Column, held: str) -> Column:
        near = F.filter(held, lambda p: F.abs(p - level) <= F.greatest(F.abs(level) * 0.001, F.lit(1e-12)))
        return F.when(level.isNull(), 0).otherwise(F.size(near))

    return out.withColumns({
        "sr_dist_support": C - s, "sr_dist_resistance": r - C, "sr_dist_support_pct": F.try_divide(C - s, C), "sr_dist_resistance_pct": F.try_divide(r - C, C),
        "distance_to_nearest_support": F.try_divide(C - s, F.col("atr_14")), "distance_to_nearest_resistance": F.try_divide(r - C, F.col("atr_14")),
        "is_at_support": flag(F.abs(C - s) <= at_level * F.col("atr_14")), "is_at_resistance": flag(F.abs(r - C) <= at_level * F.col("atr_14")),
        "nearest_support_touches": touches(s, "lows_"), "nearest_resistance_touches": touches(r, "highs_"),
    }).withColumn("strength_of_level", F.greatest("nearest_support_touches", "nearest_resistance_touches")).drop("lows_", "highs_")


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Gaps between this row and the second before; rows since; whether the close is in a gap not yet filled."""
    H, L, C = (F.col(c) for c in ("high", "low", "close"))
    h2, l2 = previous(H, 2), previous(L, 2)
    out = with_atr(bars).withColumns({"rn_": F.row_number().over(by_time()), "h2_": h2, "l2_": l2})
    out = out.withColumns({"fvg_bullish": flag(L > F.col("h2_")), "fvg_bearish": flag(H < F.col("l2_"))})
    bull, bear = F.col("fvg_bullish") == 1, F.col("fvg_bearish") == 1
    out = out.withColumns({
        "fvg_bull_low": F.when(bull, F.col("h2_")), "fvg_bull_high": F.when(bull, L), "fvg_bull_size": F.when(bull, L - F.col("h2_")),
        "fvg_bear_low": F.when(bear, H), "fvg_bear_high": F.when(bear, F.col("l2_")), "fvg_bear_size": F.when(bear, F.col("l2_") - H),
        "z1_": last_where(bull, F.struct("rn_", F.col("h2_").alias("lo"), L.alias("hi"))), "z2_": last_where(bear, F.struct("rn_", H.alias("lo"), F.col("l2_").alias("hi"))),
        "since_": last_where(bull | bear, F.col("rn_")),
    })
    after1 = Window.partitionBy("symbol", "z1_.rn_").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    after2 = Window.partitionBy("symbol", "z2_.rn_").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    open1 = F.coalesce(F.min(F.when(F.col("rn_") > F.col("z1_.rn_"), L)).over(after1) > F.col("z1_.lo"), F.col("z1_").isNotNull())
    open2 = F.coalesce(F.max(F.when(F.col("rn_") > F.col("z2_.rn_"), H)).over(after2) < F.col("z2_.hi"), F.col("z2_").isNotNull())
    inside = (open1 & C.between(F.col("z1_.lo"), F.col("z1_.hi"))) | (open2 & C.between(F.col("z2_.lo"), F.col("z2_.hi")))
    size = F.coalesce("fvg_bull_size", "fvg_bear_size")
    return out.withColumns({"fvg_size": size, "fvg_size_normalized": by_atr(size), "bars_since_fvg": F.col("rn_") - F.col("since_"), "is_price_in_fvg": flag(inside)}).drop("rn_", "h2_", "l2_", "z1_", "z2_", "since_")


def liquidity(bars: DataFrame) -> DataFrame:
    """Running extremes of the UTC day and ISO week, the close's distance to the day's in ATR, and sweeps of the day's or
    week's before (the one last seen)."""
    H, L, C = (F.col(c) for c in ("high", "low", "close"))
    ts = F.timestamp_millis("open_time")
    out = with_atr(bars).withColumns({"day_": F.date_trunc("day", ts), "week_": F.date_trunc("week", ts)})
    sweep = F.lit(False)
    for name, key in (("daily", "day_"), ("weekly", "week_")):
        w = Window.partitionBy("symbol", key).orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({f"{name}_high": F.max(H).over(w), f"{name}_low": F.min(L).over(w)})
        turned = F.col(key) != F.col(f"{key}was")
        out = out.withColumns({f"{key}was": previous(key), f"{key}h": previous(f"{name}_high"), f"{key}l": previous(f"{name}_low")})
        out = out.withColumns({f"{key}h": last_where(turned, F.col(f"{key}h")), f"{key}l": last_where(turned, F.col(f"{key}l"))})
        ph, pl = F.col(f"{key}h"), F.col(f"{key}l")
        sweep = sweep | F.coalesce((H > ph) & (C < ph), F.lit(False)) | F.coalesce((L < pl) & (C > pl), F.lit(False))
    out = out.withColumns({"distance_to_daily_high": by_atr(F.col("daily_high") - C), "distance_to_daily_low": by_atr(C - F.col("daily_low"))})
    return out.withColumn("is_liquidity_sweep", flag(sweep)).drop(*[f"{k}_{x}" for k in ("day", "week") for x in ("", "was", "h", "l")])


def order_blocks(bars: DataFrame, reach: int = 40) -> DataFrame:
    """Zones of the last opposite candle before an impulse; distance of the close to either in ATR; strength by volume."""
    O, H, L, C, V = (F.col(c) for c in ("open", "high", "low", "close", "volume"))
    out = with_atr(bars).withColumns({"rn_": F.row_number().over(by_time()), "mean_": rolling(F.avg(V), V, 20, 5)})
    source = F.struct("rn_", L.alias("lo"), H.alias("hi"), F.coalesce(F.try_divide(V, F.col("mean_")), F.lit(1.0)).alias("strength"))
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    share = F.try_divide(F.abs(C - O), H - L)
    out = out.withColumns({"b_": F.last(F.when(C < O, source), True).over(before), "s_": F.last(F.when(C > O, source), True).over(before)})
    out = out.withColumns({"up_": (C > O) & (share >= 0.55) & (H >= previous(H)) & (F.col("b_.rn_") >= F.col("rn_") - reach), "down_": (C < O) & (share >= 0.55) & (L <= previous(L)) & (F.col("s_.rn_") >= F.col("rn_") - reach)})
    out = out.withColumns({"bz_": last_where(F.col("up_"), F.col("b_")), "sz_": last_where(F.col("down_"), F.col("s_")), "ob_strength": last_where(F.coalesce("up_", F.lit(False)) | F.coalesce("down_", F.lit(False)), F.when(F.col("down_"), F.col("s_.strength")).otherwise(F.col("b_.strength")))})

    def apart(zone: str) -> Column:
        z = F.col(zone)
        return F.when(C.between(z["lo"], z["hi"]), 0.0).otherwise(F.least(F.abs(C - z["lo"]), F.abs(C - z["hi"])))

    return out.withColumns({"bull_ob_low": F.col("bz_.lo"), "bull_ob_high": F.col("bz_.hi"), "bear_ob_low": F.col("sz_.lo"), "bear_ob_high": F.col("sz_.hi"), "last_bullish_ob_distance": by_atr(F.when(F.col("bz_").isNotNull(), apart("bz_"))), "last_bearish_ob_distance": by_atr(F.when(F.col("sz_").isNotNull(), apart("sz_")))}).drop("rn_", "mean_", "b_", "s_", "up_", "down_", "bz_", "sz_")


def structure(bars: DataFrame) -> DataFrame:
    """Market structure of the last two swings, breaks and changes of it, distances of the close to the Fibonacci levels in
    ATR, and the OTE flag."""
    H, L, C = (F.col(c) for c in ("high", "low", "close"))
    out = swing_flags(with_atr(bars))
    for kind, price in (("high", H), ("low", L)):
        out = out.withColumn(f"{kind}_", F.struct(price.alias("now"), F.lag(price).over(among(f"is_swing_{kind}")).alias("old")))
        out = out.withColumn(f"{kind}_", last_where(F.col(f"is_swing_{kind}") == 1, F.col(f"{kind}_")))
    h2, h1, l2, l1 = F.col("high_.now"), F.col("high_.old"), F.col("low_.now"), F.col("low_.old")
    out = out.withColumn("market_structure", F.when((h2 > h1) & (l2 > l1), 1).when((h2 < h1) & (l2 < l1), -1).otherwise(0))
    bull, bear = C > previous("high_.now"), C < previous("low_.now")
    out = out.withColumns({"break_of_structure_bull": flag(bull), "break_of_structure_bear": flag(bear)})
    was = previous("market_structure")
    span = F.when(h2 > l2, h2 - l2)
    levels = {f"fib_0_{str(f)[2:]}_distance": by_atr(C - (h2 - f * span)) for f in (0.382, 0.5, 0.618, 0.786)}
    return out.withColumns({
        "choch_bullish": flag((was == -1) & (F.col("break_of_structure_bull") == 1)), "choch_bearish": flag((was == 1) & (F.col("break_of_structure_bear") == 1)),
        **levels, "is_in_ote_zone": flag(F.try_divide(h2 - C, span).between(0.618, 0.786)),
        "smc_last_swing_high": h2, "smc_last_swing_low": l2, "smc_bos_up": F.col("break_of_structure_bull"), "smc_bos_down": F.col("break_of_structure_bear"),
    }).drop("high_", "low_")


def legacy(bars: DataFrame) -> DataFrame:
    """Grabs beyond the 20 rows before, displacement candles, and the close's place in the 50-row range."""
    O, H, L, C = (F.col(c) for c in ("open", "high", "low", "close"))
    high, low = rolling(F.max(H), H, 20, 3, -1), rolling(F.min(L), L, 20, 3, -1)
    lo, hi = rolling(F.min(L), L, 50, 5), rolling(F.max(H), H, 50, 5)
    place = F.try_divide(C - lo, hi - lo)
    return bars.withColumns({
        "smc_liq_grab_high": flag((H > high) & (C < high)), "smc_liq_grab_low": flag((L < low) & (C > low)),
        "smc_displacement": flag(F.try_divide(F.abs(C - O), H - L) >= 0.65), "smc_premium_discount": F.when(place.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))),
    })
