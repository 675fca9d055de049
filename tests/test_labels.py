"""Exits by range minima against loops over held bars."""

import datetime as dt
import random

import numpy as np

from tidemark.operators import labels as L

SIGNALS = "symbol_id long, signal_bar int, signal_date date, entry_bar int, entry_date date, entry double, sl double, target double, atr double, score double"
BARS = "symbol_id long, d date, bar int, open double, high double, low double, close double, volume long, ema7 double, ema21 double"


def test_first_passage_equals_a_scan():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 200):
        values = rnd.integers(0, 50, n).astype(float)
        levels, start = L.minima(values), rnd.integers(0, n + 1, 300)
        end, limit = np.minimum(n - 1, start + rnd.integers(-1, n, 300)), rnd.integers(-5, 30, 300).astype(float)
        want = [next((i for i in range(a, b + 1) if values[i] <= x), n) for a, b, x in zip(start, end, limit)]
        assert np.where(L.first_at_most(levels, start, end, limit) > end, n, L.first_at_most(levels, start, end, limit)).tolist() == want


def walk(symbol, n):
    rnd, close, rows = random.Random(symbol), 50.0, []
    for k in range(n):
        opened, close = close, max(1.0, close * (1 + rnd.uniform(-0.03, 0.03)))
        rows.append((symbol, dt.date(2020, 1, 1) + dt.timedelta(k), k + 1, opened, max(opened, close) * 1.005, min(opened, close) * 0.995, close, 1, rnd.random() if k > 6 else None, 0.15 if k > 20 else None))
    return rows


def plain(signal, bars, rule, hold):
    _, _, _, entry_bar, _, entry, sl, target, atr, _ = signal
    peak = entry
    for _, d, bar, _, high, low, close, _, e7, e21 in bars[entry_bar - 1 :]:
        stop = max(sl, peak - 1.5 * atr) if rule == "trailing" and peak > entry and atr and atr > 0 else sl
        if low <= stop:
            return ("trail_stop" if stop > sl else "stop" if rule in ("recross", "target") else "loss"), bar, stop
        if rule in ("barrier", "trailing") and target > 0 and high >= target:
            return "win", bar, target
        if rule == "target" and bar > entry_bar and target > 0 and high >= target:
            return "target", bar, target
        if rule == "recross" and bar > entry_bar and e7 is not None and e21 is not None and e7 < e21:
            return "recross", bar, close
        if hold and bar - entry_bar + (rule in ("barrier", "trailing")) >= hold:
            return "timeout", bar, close
        peak = max(peak, high)
    return ("timeout" if rule in ("barrier", "trailing") else "open"), bars[-1][2], bars[-1][6]


def test_labels_equal_loops_at_any_hold(spark):
    rnd = random.Random(4)
    bars = {s: walk(s, n) for s, n in ((1, 400), (2, 60), (3, 5))}
    signals = []
    for s, rows in bars.items():
        for k in range(min(60, len(rows) - 1)):
            at = rnd.randrange(len(rows) - 1)
            entry = rows[at + 1][3]
            signals.append((s, 1000 * at + k, rows[at][1], at + 2, rows[at + 1][1], entry, entry * rnd.uniform(0.7, 0.99), rnd.choice([0.0, entry * rnd.uniform(1.01, 1.4)]), rnd.choice([None, 0.0, 1.2]), 1.0))
    frame, rows = spark.createDataFrame(signals + [(9, 1, None, 2, None, 1.0, 0.5, 2.0, 1.0, 1.0)], SIGNALS), spark.createDataFrame([r for x in bars.values() for r in x], BARS)
    for hold in (None, 1, 20):
        for rule, made in (("barrier", L.barrier(frame, rows, hold)), ("trailing", L.trailing(frame, rows, max_hold=hold)), ("recross", L.ema_exit(frame, rows, max_hold=hold)), ("target", L.ema_exit(frame, rows, max_hold=hold, target_exit=True))):
            got = {(r["symbol_id"], r["signal_bar"]): (r["outcome" if rule in ("barrier", "trailing") else "status"], r["exit_bar"], r["exit_price"]) for r in made.collect()}
            assert got == {(s[0], s[1]): plain(s, bars[s[0]], rule, hold) for s in signals}, (rule, hold)
