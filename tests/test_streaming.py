"""Streams with state: micro-batches against the batch operators, restarts, and what a batch reads."""

import datetime as dt
import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators.logs import upsert
from tidemark.streaming import jobs as J
from tidemark.operators import state as S

CANDLES = "symbol_id long, d date, bar int, open double, high double, low double, close double, volume long"
QUOTES = "token long, ts timestamp, seq long, last_price double, open double, high double, low double, volume long"
FIRST = dt.date(2023, 1, 2)


def walk(symbol, bars):
    rnd, close, rows = random.Random(symbol), 100.0, []
    for k in range(bars):
        opened = close
        close = round(max(5.0, close * (1 + 0.012 * math.sin(k / 9 + symbol) + 0.002 + rnd.uniform(-0.01, 0.01))), 2)
        high, low = round(max(opened, close) * (1 + rnd.random() / 100), 2), round(min(opened, close) * (1 - rnd.random() / 100), 2)
        rows.append((symbol, FIRST + dt.timedelta(k), k + 1, opened, high, low, close, rnd.randrange(1000, 5000)))
    return rows


@pytest.fixture(scope="module")
def history():
    return {s: walk(s, 230 if s % 5 else (1, 2, 5, 14, 21)[s // 5 % 5]) for s in range(1, 26)}


def test_state_advances_as_the_batch_indicators(spark, history):
    """Bar after bar from a part of each history: the values of the whole one."""
    frame = spark.createDataFrame([r for rows in history.values() for r in rows], CANDLES)
    cut = {s: max(1, len(rows) - 12) for s, rows in history.items()}
    state = S.initial_state(spark.createDataFrame([r for s, rows in history.items() for r in rows[: cut[s]]], CANDLES))
    for step in range(12):
        bars = [(s, *(rows[cut[s] + step][k] for k in (1, 3, 4, 5, 6, 7)), True) for s, rows in history.items() if cut[s] + step < len(rows)]
        state = S.with_live_bars(state, spark.createDataFrame(bars, "symbol_id long, d date, open double, high double, low double, close double, volume long, opened boolean")).drop("changed", "opened")
        if step % 4 == 3:
            state = spark.createDataFrame(state.collect(), state.schema)
    got = {r["symbol_id"]: r for r in S.live_features(state.withColumn("opened", F.lit(True))).collect()}
    rows, extremes = scans.features(frame, last_only=True)
    want, zones = {r["symbol_id"]: r for r in rows.collect()}, {r["symbol_id"]: r for r in extremes.collect()}
    assert set(got) == set(want)
    for s, w in want.items():
        for c in ("d", "bar", "close", "volume", *(f"ema{p}" for p in (7, 10, 20, 21, 50, 200)), "atr14", "rsi2", "rsi14", "avg_volume", "volume_ratio", "close10", "ema200_past", "trend"):
            assert got[s][c] == w[c], (s, c)
        for c in ("lows", "highs"):
            assert [tuple(x) for x in got[s][c]] == [tuple(x) for x in zones[s][c] if x["confirm_bar"] <= w["bar"]]


def quotes_of(history, day, hour, factor):
    ts = dt.datetime.combine(day, dt.time(hour), dt.timezone.utc)
    out = []
    for s, rows in history.items():
        if (s + hour) % 7:
            last = rows[-1][6]
            price = round(last * (factor + (s % 3 - 1) / 100), 2)
            out.append((s, ts, s, price, last if s % 4 else None, max(last, price), min(last, price), 900))
    return out


def test_live_scan_equals_the_batch_scan(spark, history, tmp_path):
    path = f"{tmp_path}/history"
    spark.createDataFrame([r for rows in history.values() for r in rows], CANDLES).write.parquet(path)
    merged = spark.createDataFrame(spark.read.parquet(path).collect(), CANDLES)
    scan = J.LiveScan.begin(spark.read.parquet(path), f"{tmp_path}/state", swing=scans.LENIENT)
    shutil.rmtree(path)  # no batch reads the history
    # Thursday, twice, Friday, a closed Saturday, Monday, twice
    days = [(dt.date(2024, 1, 4), 5, 1.01), (dt.date(2024, 1, 4), 8, 0.99), (dt.date(2024, 1, 5), 5, 1.02), (dt.date(2024, 1, 6), 5, 1.0), (dt.date(2024, 1, 8), 6, 1.0), (dt.date(2024, 1, 8), 6, 1.0)]
    streaks, runs = {}, 0
    for number, (day, hour, factor) in enumerate(days):
        batch = spark.createDataFrame(quotes_of(history, day, hour, factor), QUOTES)
        found = {(r["mode"], r["symbol_id"]): r for r in scan(batch, number).collect()}
        if number == 2:  # as if it had failed before its offsets were committed
            assert {k: tuple(r) for k, r in found.items()} == {(r["mode"], r["symbol_id"]): tuple(r) for r in scan(batch, number).collect()}
        newest = merged.groupBy("symbol_id").agg(F.max("d").alias("last_d"))
        bars = J.live_bars(batch, newest)
        if day.weekday() == 5:
            assert not found
            continue
        last = merged.groupBy("symbol_id").agg(F.max(F.struct("d", "bar")).alias("h"))
        numbered = bars.join(last, "symbol_id").select("symbol_id", "d", (F.col("h.bar") + (F.col("d") > F.col("h.d")).cast("int")).alias("bar"), "open", "high", "low", "close", "volume")
        merged = spark.createDataFrame(upsert(merged, numbered, ["symbol_id", "d"]).collect(), merged.schema)
        live = {r["symbol_id"] for r in bars.collect()}
        want = {}
        for mode, judged in (("breakout", scans.breakout(*scans.features(merged, last_only=True, strategy="breakout"))), ("swing", scans.swing(*scans.features(merged, last_only=True, strategy="swing"), scans.LENIENT))):
            want |= {(mode, r["symbol_id"]): (r["close"], r["volume"], r["reason"], r["score"]) for r in judged.collect() if r["symbol_id"] in live}
        assert {k: (r["close"], r["volume"], r["reason"], r["score"]) for k, r in found.items()} == want
        signals = {k for k, w in want.items() if w[2] is None}
        before, streaks = streaks, {k: streaks.get(k, 0) + 1 for k in signals}
        assert {k: r["streak"] for k, r in found.items() if r["streak"] is not None} == streaks
        assert {k: r["is_new"] for k, r in found.items() if r["streak"] is not None} == {k: runs > 0 and k not in before for k in signals}
        runs += 1
    assert streaks and max(streaks.values()) > 1


def test_streaks_go_on_after_a_restart(spark, tmp_path):
    rnd, start = random.Random(8), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    ticks = sorted((k, start + dt.timedelta(minutes=rnd.randrange(12 * 1440)), s, rnd.randrange(100) / 4) for k, s in enumerate(rnd.choices(range(9), range(1, 10), k=120)))
    ticks.sort(key=lambda t: t[1])
    source, sink = f"{tmp_path}/ticks", f"{tmp_path}/streaks"
    schema = "seq long, ts timestamp, token long, last_price double"
    for part in range(3):
        spark.createDataFrame(ticks[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        with J.with_rocksdb(spark):  # another query, from the checkpoint of the one before
            out = J.drain(J.daily_streaks(stream), "append", "streaks", path=sink)
    got = {(r["symbol"], r["day"]): (r["score"], r["streak"]) for r in out.collect()}
    want = {}
    for _, ts, s, price in ticks:
        want[s, ts.date()] = want.get((s, ts.date()), 0) + round(price * 100)
    end = (ticks[-1][1] - dt.timedelta(minutes=10)).date()
    want = {k: v for k, v in want.items() if k[1] < end}
    streaks = {}
    for s, day in sorted(want):
        streaks[s, day] = streaks.get((s, day - dt.timedelta(1)), 0) + 1
    assert got == {k: (v, streaks[k]) for k, v in want.items()} and max(streaks.values()) > 3
