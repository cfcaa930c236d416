"""Feature tables over several intervals: the technical matrix, the full feature matrix, its sink and its reader.

The bars of all intervals are one table, whose symbols are ``symbol|interval``: what is made of bars of one interval is made
once for all of them, in the same pass. Then they are dealt by symbol, and one window gives each base row the last row of
every longer interval; all that follows looks along the same order and needs no other exchange, and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.functions.windows import by_time, flag

from . import backtest, labels, patterns
from .indicators import TECHNICAL, technical

RAW = ["open", "high", "low", "close", "volume"]
LEVELS = [
    "sr_nearest_support", "sr_nearest_resistance", "sr_dist_support", "sr_dist_resistance", "sr_dist_support_pct", "sr_dist_resistance_pct", "distance_to_nearest_support",
    "distance_to_nearest_resistance", "is_at_support", "is_at_resistance", "nearest_support_touches", "nearest_resistance_touches", "strength_of_level",
]
LABELS = ["would_trade_successful", "optimal_sl", "optimal_tp", "optimal_sl_pct", "optimal_tp_pct"]


def together(frames: dict[str, DataFrame]) -> DataFrame:
    """The bars of all intervals as one table of ``symbol|interval``."""
    parts = [b.select(F.concat_ws("|", "symbol", F.lit(i)).alias("symbol"), "open_time", *RAW) for i, b in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_of_base(rows: DataFrame, intervals: list[str], own: list[str], held: list[str]) -> DataFrame:
    """The rows of the first of ``intervals`` with ``own`` under their names, and ``held`` of it and of the last row so far of
    every other interval as structs ``at_{interval}``; equal times count as so far.

    ``rows`` are of ``together``. One exchange by symbol, one sort.
    """
    base, *longer = intervals
    parts = F.split(F.col("symbol"), r"\|(?=[^|]*$)")
    keyed = rows.select(parts[0].alias("symbol"), parts[1].alias("interval_"), "open_time", *own, F.struct(*held).alias(f"at_{base}"))
    so_far = Window.partitionBy("symbol").orderBy("open_time", F.col("interval_") == base).rowsBetween(Window.unboundedPreceding, 0)
    last = {f"at_{i}": F.last(F.when(F.col("interval_") == i, F.col(f"at_{base}")), ignorenulls=True).over(so_far) for i in longer}
    return keyed.withColumns(last).where(F.col("interval_") == base).drop("interval_")


def flat(rows: DataFrame, intervals: list[str], held: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the structs of ``as_of_base`` as columns ``{interval}_{name}``, without those to ``drop``."""
    inner = [F.col(f"at_{i}.{c}").alias(f"{i}_{c}") for i in intervals for c in held if f"{i}_{c}" not in drop]
    return rows.select(*[c for c in rows.columns if not (c.startswith("at_") and c[3:] in intervals)], *inner)


def matrix(frames: dict[str, DataFrame], vp_window: int = 96, vp_bins: int = 24) -> DataFrame:
    """The base bars (the first of ``frames``) with all columns of ``technical`` of every interval, each made on its own bars,
    as ``{interval}_{name}``."""
    return flat(as_of_base(technical(together(frames), vp_window, vp_bins), list(frames), RAW, TECHNICAL), list(frames), TECHNICAL)


def regime_columns(rows: DataFrame, names: dict[str, str], n: int = 100) -> DataFrame:
    """``rows`` with trend_strength, volatility_regime, the flags of the base (the first of ``names``, interval: name) and
    ``regime_{name}`` of each interval, from ``{interval}_adx_14`` and ``{interval}_atr_14``; null where those are missing."""
    base = next(iter(names))
    found = [i for i in names if {f"{i}_adx_14", f"{i}_atr_14"} <= set(rows.columns)]
    out = rows.withColumns({f"rank_{i}": labels.percentile_rank(F.col(f"{i}_atr_14"), n) for i in found})
    a, p = F.col(f"{base}_adx_14"), F.col(f"rank_{base}")
    flags = {"trend_strength": a, "volatility_regime": p, "regime_trending": flag(a > 25), "regime_ranging": flag(a < 20), "regime_volatile": flag(p >= 0.75)}
    of = {f"regime_{name}": labels.composite(F.col(f"{i}_adx_14"), F.col(f"rank_{i}")).cast("double") if i in found else F.lit(None).cast("double") for i, name in names.items()}
    return out.withColumns(flags | of).drop(*[f"rank_{i}" for i in found])


def feature_matrix(frames: dict[str, DataFrame], signals: DataFrame | None = None, minutes: int = 15, label_rows: int = 384) -> DataFrame:
    """All features of the base bars: technical ones and levels of every interval, patterns, structure, regimes, targets.

    ``frames``: base first, with names like 15m; longer ones also give their last bar (``{interval}_open`` and so on).
    ``signals``: what the trade labels are made of, looked at ``label_rows`` rows ahead; without them, and at other rows, the
    labels are null. Only these are joined to the rows, by symbol and time.
    """
    base, *_ = frames
    made = patterns.support_resistance(technical(together(frames)))
    held = [*RAW, *TECHNICAL, *LEVELS]
    own = [*[f"{i}_{c}" for i in frames for c in ("adx_14", "atr_14")]]
    out = as_of_base(made, list(frames), [*RAW, *LEVELS], held)
    out = out.withColumns({**{f"{i}_{c}": F.col(f"at_{i}.{c}") for i in frames for c in ("adx_14", "atr_14")}, "atr_14": F.col(f"at_{base}.atr_14")})
    out = patterns.fair_value_gaps(patterns.swings(patterns.candles(out)))
    out = patterns.legacy(patterns.structure(patterns.order_blocks(patterns.liquidity(out))))
    out = regime_columns(out, {i: {"m": "M", "h": "H"}.get(i[-1], i[-1]) + i[:-1] for i in frames})
    out = labels.legacy_targets(labels.targets(out, minutes))
    C, atr = F.col("close"), F.col(f"{base}_atr_14")
    ahead = {name: F.lead(C, max(1, round(60 * hours / minutes))).over(by_time()) for name, hours in (("1h", 1), ("4h", 4), ("1d", 24))}
    out = out.withColumns({f"target_risk_adjusted_return_{name}": F.try_divide(F.try_divide(x - C, C), atr) for name, x in ahead.items()})
    out = flat(out.drop("atr_14", *own), list(frames), held, tuple(f"{base}_{c}" for c in (*RAW, *LEVELS)))
    if signals is None:
        return out.withColumns({c: F.lit(None).cast("double") for c in LABELS})
    found = backtest.trade_labels(signals, frames[base], label_rows).select("symbol", "open_time", *LABELS)
    return out.join(found, ["symbol", "open_time"], "left")


def feature_names(matrix_: DataFrame, targets: bool = False, ids: bool = False) -> list[str]:
    """Columns that are features: without symbol and open_time, and without targets."""
    return [c for c in matrix_.columns if (ids or c not in ("symbol", "open_time")) and (targets or not c.startswith("target_"))]


def write_features(matrix_: DataFrame, table: str, buckets: int = 64) -> None:
    """``matrix_`` as a Parquet table bucketed by symbol and sorted by time in each bucket, so that joins and windows by symbol
    read it without an exchange."""
    matrix_.write.format("parquet").bucketBy(buckets, "symbol").sortBy("symbol", "open_time").mode("overwrite").saveAsTable(table)


def read_features(spark: SparkSession, table: str, symbols: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """The table again: some symbols (only their buckets are read) and open times from ``start`` to ``end``, both included."""
    out = spark.table(table)
    if symbols:
        out = out.where(F.col("symbol").isin(symbols))
    if start is not None:
        out = out.where(F.col("open_time") >= start)
    return out if end is None else out.where(F.col("open_time") <= end)


def with_raw_bars(rows: DataFrame, frames: dict[str, DataFrame], base: str) -> DataFrame:
    """``rows`` with the last bar of each longer interval as ``{interval}_{name}``, as far as such columns are missing, and the
    base bar's own under ``{base}_{name}``."""
    out = rows.withColumns({f"{base}_{c}": F.col(c).cast("double") for c in RAW if f"{base}_{c}" not in rows.columns})
    for i, b in frames.items():
        lacking = [c for c in RAW if f"{i}_{c}" not in out.columns]
        if i != base and lacking:
            out = backtest.asof(out, b.select("symbol", "open_time", *[F.col(c).alias(f"{i}_{c}") for c in lacking]))
    return out


def time_ms(value: Column) -> Column:
    """Epoch milliseconds of a time given as such, as digits, or as a timestamp's text in UTC; null where it is none of these."""
    text = F.trim(value.cast("string"))
    stamp = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("dd.MM.yyyy HH:mm")))
    return F.when(text.rlike(r"^-?[0-9]{1,18}$"), text.try_cast("bigint")).otherwise(F.unix_millis(stamp))
