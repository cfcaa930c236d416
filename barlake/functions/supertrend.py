"""Supertrend: bands that ratchet towards the price until it crosses them, as steps of ``walk``."""

from __future__ import annotations


def strategy_step(period: int, times: float):
    """Steps over high, low, close: (line, way). The average true range starts with the first row; the line starts below."""

    def step(state, h: float, lo: float, c: float) -> tuple:
        if state is None:
            avg = h - lo
            up, down = (h + lo) / 2 + times * avg, (h + lo) / 2 - times * avg
            return (avg, up, down, c, 1), down, 1
        avg, fu, fl, before, way = state
        avg += (max(h - lo, abs(h - before), abs(lo - before)) - avg) / period
        up, down = (h + lo) / 2 + times * avg, (h + lo) / 2 - times * avg
        fu = up if up < fu or before > fu else fu
        fl = down if down > fl or before < fl else fl
        way = 1 if (c > fu if way == -1 else c >= fl) else -1
        return (avg, fu, fl, c, way), (fl if way == 1 else fu), way

    return step


def feature_step(times: float, intended: bool):
    """Steps over high, low, close and ATR: (line, way). Rows before ATR starts have no line and way 0.

    As known results have it, bands that start unknown stay so, and no line ever comes; ``intended``: they start with ATR,
    from above.
    """

    def step(state, h: float, lo: float, c: float, atr: float | None) -> tuple:
        if state == "never" or atr is None:
            return (state if intended else "never"), None, 0
        up, down = (h + lo) / 2 + times * atr, (h + lo) / 2 - times * atr
        if state is None:
            return (up, down, c, -1), up, -1
        fu, fl, before, way = state
        fu = up if up < fu or before > fu else fu
        fl = down if down > fl or before < fl else fl
        way = (1 if c > fu else -1) if way == -1 else (1 if c >= fl else -1)
        return (fu, fl, c, way), (fl if way == 1 else fu), way

    return step
