"""Exponential averages over many blocks against a plain loop."""

from __future__ import annotations

import math

import numpy as np

from barlake.functions.windows import ewm


def test_long_series(spark):
    x = np.random.default_rng(1).normal(100, 5, 3000).cumsum()
    rows = [("a", i, None if i < 5 else float(v)) for i, v in enumerate(x)] + [("b", i, float(i)) for i in range(3)]
    spans = {"fast": (0.5, 1), "mid": (2 / 21, 20), "slow": (2 / 401, 1)}
    found = ewm(spark.createDataFrame(rows, "symbol string, open_time long, x double"), {k: ("x", a, n) for k, (a, n) in spans.items()}).collect()
    assert len(found) == len(rows)
    for symbol in "ab":
        own = sorted((r for r in found if r.symbol == symbol), key=lambda r: r.open_time)
        for name, (alpha, least) in spans.items():
            y, n = None, 0
            for r in own:
                if r.x is not None:
                    y, n = (r.x if y is None else (1 - alpha) * y + alpha * r.x), n + 1
                assert (r[name] is None) == (n < least)
                assert n < least or math.isclose(r[name], y, rel_tol=1e-9)
