"""Links and trades against plain loops over the rows."""

from __future__ import annotations

import bisect
import math
import random

import pytest

from barlake.functions import links
from barlake.operators import backtest


def test_first_mark_at_or_after(spark):
    draw = random.Random(2)
    marks = [(s, t, t * 10) for s in "ab" for t in sorted(draw.sample(range(-200, 3000), 60))]
    asks = [(s, draw.randrange(-300, 3200)) for s in "abc" for _ in range(80)]
    asks += asks[:5]
    known = {s: [t for k, t, _ in marks if k == s] for s in "abc"}
    want = {(s, t): known[s][i] * 10 if (i := bisect.bisect_left(known[s], t)) < len(known[s]) else None for s, t in asks}
    for width in (1, 7, 100, 100_000):
        found = links.first_from(spark.createDataFrame(marks, "symbol string, at_ long, found_ long"), spark.createDataFrame(asks, "symbol string, at_ long"), width).collect()
        assert {(r.symbol, r.at_): r.found_ for r in found} == want and len(found) == len(want)


def walked(rows, capital, fee, slip):
    """The same trades by one loop a symbol: {(symbol, row): (cash before, cash after)}."""
    out, state = {}, {}
    for symbol, at, side, entry, price, until, why in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3], r[4], r[5] + (r[6] == "eod"))):
        free, cash = state.get(symbol, (0, capital))
        if at < free or cash <= 0:
            continue
        if side == "long":
            after = cash / (entry * (1 + slip) * (1 + fee)) * price * (1 - slip) * (1 - fee)
        else:
            sold = entry * (1 - slip)
            after = cash + cash / (sold * (1 + fee)) * (sold * (1 - fee) - price * (1 + slip) * (1 + fee))
        state[symbol] = (until + (why == "eod"), after)
        out[symbol, at] = (cash, after)
    return out


@pytest.mark.parametrize("ruin", [False, True])
def test_trades_are_those_of_a_loop(spark, ruin):
    draw = random.Random(5)
    rows = []
    for symbol, n in (("a", 300), ("b", 1), ("c", 40)):
        for at in draw.sample(range(1, 20_000 if symbol == "a" else 50), n):
            until = at + draw.randrange(1, 60)
            price = 100 * draw.uniform(0.9, 4 if ruin else 1.1)
            rows.append((symbol, at, draw.choice(["long", "short"]), 100.0, price, until, "eod" if draw.random() < 0.05 else "tp"))
    rows += rows[::9]  # repeated rows
    rows += [(s, at, "short", e, p + 1, u + 3, w) for s, at, _, e, p, u, w in rows[::7]]  # two signals on one bar
    made = spark.createDataFrame([(s, at * 900_000, side, e, e * 0.9, e * 1.1, 0, at, u * 900_000, p, w, u) for s, at, side, e, p, u, w in rows], "symbol string, open_time long, side string, entry double, stop_loss double, take_profit double, deadline long, s_rn int, exit_time long, exit_price double, exit_reason string, exit_rn int")
    found = backtest.trades(made)
    assert "Python" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "ArrowEval" not in plan
    found = {(r.symbol, r.entry_time // 900_000): (r.cash_after - r.pnl, r.cash_after) for r in found.collect()}
    want = walked(rows, 10_000.0, 0.001, 0.0005)
    assert found.keys() == want.keys()
    assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6) for k in want for x, y in zip(found[k], want[k], strict=True))
    assert not ruin or any(after <= 0 for _, after in want.values())
    assert backtest.trades(made.where("1 = 0")).count() == 0
