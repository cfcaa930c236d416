"""Columns made of arrays: each symbol's rows in order, some thousand at a time, with a state carried in between.

For what has no short windowed form: averages that never forget, histograms of sliding windows. One exchange and one sort;
a symbol of any length needs the memory of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barlake.shipping import ship

Arrays = dict[str, np.ndarray]
#: Rows of an average that are one product of a matrix.
BLOCK = 128
_decays: dict[float, tuple[np.ndarray, np.ndarray]] = {}


def carried(rows: DataFrame, inputs: list[str], made: list[str], step: Callable[[dict | None, Arrays], tuple[dict, Arrays]]) -> DataFrame:
    """``rows`` with the doubles ``made``: ``step(state, inputs)`` gives (new state, outputs) for each run of a symbol's rows,
    by open_time. The state is None where a symbol starts; nulls come and go as NaN. An empty table gives an empty table."""
    ship(rows.sparkSession)
    source = rows.select(*[c for c in rows.columns if c not in made])
    schema = source.schema
    for name in made:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            column = {c: b.column(b.schema.get_field_index(c)) for c in ("symbol", *inputs)}
            codes = column["symbol"].dictionary_encode()
            each, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            values = {c: column[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in inputs}
            out = {c: np.full(b.num_rows, np.nan) for c in made}
            starts = [0, *(np.flatnonzero(np.diff(each)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(starts, starts[1:], strict=False):
                symbol = names[each[lo]]
                if symbol != now:
                    now, state = symbol, None
                state, found = step(state, {c: x[lo:hi] for c, x in values.items()})
                for c, x in found.items():
                    out[c][lo:hi] = x
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.float64(), from_pandas=True) for x in out.values()]], [*b.schema.names, *made])

    return source.repartition("symbol").sortWithinPartitions("symbol", "open_time").mapInArrow(run, schema)


def _decay(alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a block's values in its averages, and of the average before it."""
    if alpha not in _decays:
        powers = (1 - alpha) ** np.arange(BLOCK + 1)
        apart = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
        _decays[alpha] = np.where(apart >= 0, alpha * powers[np.abs(apart)], 0.0), powers[1:]
    return _decays[alpha]


def average(state: tuple[int, float] | None, x: np.ndarray, alpha: float, least: int = 1) -> tuple[tuple[int, float], np.ndarray]:
    """(state, y): y = (1 - alpha) * y before + alpha * x, from the first value on; NaN before ``least`` values. State: how many
    values, and the last y. Inputs may start with NaN but have none in between."""
    seen, last = state or (0, np.nan)
    out = np.full(len(x), np.nan)
    skip = 0 if seen else int(np.argmax(~np.isnan(x))) if not np.isnan(x).all() else len(x)
    values = x[skip:]
    if len(values):
        weights, powers = _decay(alpha)
        last = last if seen else values[0]
        for lo in range(0, len(values), BLOCK):
            part = values[lo : lo + BLOCK]
            y = weights[: len(part), : len(part)] @ part + powers[: len(part)] * last
            out[skip + lo : skip + lo + len(part)] = y
            last = y[-1]
        out[skip : skip + max(0, least - 1 - seen)] = np.nan
    return (seen + len(values), last), out


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is 0."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def poc(tail: tuple[np.ndarray, np.ndarray] | None, price: np.ndarray, volume: np.ndarray, window: int, bins: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(tail, middle of the price bin with the most volume in the last ``window`` rows, the lowest at a tie; the mean if the
    window is flat; NaN before it is full). Tail: the rows that the next ones look back on."""
    p, v = (np.concatenate([t, x]) for t, x in zip(tail or (price[:0], price[:0]), (price, volume), strict=True))
    out = np.full(len(price), np.nan)
    full = len(p) - window + 1
    for lo in range(0, max(0, full), 2048):
        seen, weight = (np.lib.stride_tricks.sliding_window_view(x, window)[lo : min(full, lo + 2048)] for x in (p, v))
        low, high = seen.min(axis=1), seen.max(axis=1)
        width = (high - low) / bins
        guess = np.floor((seen - low[:, None]) / np.where(width > 0, width, 1.0)[:, None])
        edge = low[:, None] + guess * width[:, None]
        at = guess - (seen < edge) + ((seen >= low[:, None] + (guess + 1) * width[:, None]) & (seen >= edge))
        cell = np.clip(np.nan_to_num(at), 0, bins - 1).astype(np.int64) + np.arange(len(seen))[:, None] * bins
        best = np.bincount(cell.ravel(), np.nan_to_num(weight).ravel(), len(seen) * bins).reshape(-1, bins).argmax(axis=1)
        found = np.where(high > low, low + (best + 0.5) * width, seen.mean(axis=1))
        first = len(price) - full + lo
        out[first : first + len(found)] = found
    return (p[max(0, len(p) - window + 1) :], v[max(0, len(v) - window + 1) :]), out
