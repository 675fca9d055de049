"""Fills of a day's queue, against a plain loop over a purse."""

import datetime as dt
import math
import random

from tidemark.operators import positions as P


def plain(orders, cash, equity, o):
    queue = sorted(sorted(orders, key=lambda x: (-x[1], x[0]))[: o.slots])
    out = []
    for symbol, _, opened, low, sl in queue:
        entry = opened * (1 + o.slip)
        risk = (entry - sl) / entry
        notional = min(equity * (o.risk_pct / 100) / risk, equity * (o.max_weight_pct / 100), cash) if risk > 0 else 0.0
        shares = math.floor(notional / (entry * (1 + o.leg_cost)))
        if shares <= 0:
            continue
        cost = shares * (entry * (1 + o.leg_cost))
        back = shares * (sl * (1 - o.slip)) * (1 - o.leg_cost) if low <= sl else 0.0
        cash = cash - cost + back
        out.append((symbol, shares, low <= sl, round(cash, 6)))
    return out


def test_fills_equal_a_loop_with_the_cash_left(spark):
    rng = random.Random(5)
    rows, purses = [], {}
    for k in range(60):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=k)
        purses[day] = (rng.choice([900.0, 20_000.0, 60_000.0]), 60_000.0)
        for symbol in rng.sample(range(40), rng.randint(1, 9)):
            opened = rng.uniform(5, 3000)
            sl = opened * rng.choice([0.6, 0.9, 0.97, 1.1])
            rows.append((day, symbol, float(rng.randint(50, 60)), opened, opened * rng.uniform(0.85, 1), sl))
    purse = spark.createDataFrame([(d, *v) for d, v in purses.items()], "entry_date date, cash double, equity double")
    pending = spark.createDataFrame(rows, "entry_date date, symbol_id long, score double, open double, low double, sl double")
    o = P.FillOptions(slots=6)
    got: dict = {}
    for r in P.fill(pending, purse, o).collect():
        got.setdefault(r.entry_date, []).append((r.symbol_id, r.shares, r.stopped, round(r.cash, 6)))
        assert (r.exit is not None) == r.stopped == (r.pnl is not None)
    wanted = {d: plain([x[1:] for x in rows if x[0] == d], *purses[d], o) for d in purses}
    assert {d: sorted(v) for d, v in got.items()} == {d: v for d, v in wanted.items() if v}
    assert any(s for v in wanted.values() for _, _, s, _ in v)
    # a dear symbol takes but what it can: later ones still buy
    assert any(len(v) < min(6, len([x for x in rows if x[0] == d])) for d, v in wanted.items())


def test_fills_of_nothing(spark):
    purse = spark.createDataFrame([], "entry_date date, cash double, equity double")
    pending = spark.createDataFrame([(dt.date(2024, 1, 1), 1, 1.0, 10.0, 9.0, 8.0)], "entry_date date, symbol_id long, score double, open double, low double, sl double")
    assert P.fill(pending, purse).count() == 0
    assert P.fill(pending.limit(0), purse).count() == 0
