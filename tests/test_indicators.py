import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import indicators as I
from tidemark.operators import labels as L
from tidemark.operators import logs, scans
from tidemark.operators import statistics as T
from tidemark.operators import zones as Z
from tidemark.sources import fixtures as fx
from tidemark.sources.readers import read_candles_csv

SF = "/root/testdata/sf0.001"


def bars(spark, closes, spread=0.0, symbol=1):
    rows = [(symbol, f"1995-01-01", k + 1, c, c + spread, c - spread, c, 1000) for k, c in enumerate(closes)]
    frame = spark.createDataFrame(rows, "symbol_id long, day string, bar int, open double, high double, low double, close double, volume long")
    return frame.withColumn("d", F.date_add(F.col("day").cast("date"), F.col("bar"))).drop("day")


def test_ema_starts_with_the_mean_of_the_first():
    assert I.ema([2.0, 4.0, 6.0, 8.0, 10.0], 3) == [None, None, 4.0, 6.0, 8.0]
    assert I.ema([10.0, 20.0, 30.0], 4) == [None, None, None]


def test_rsi_equals_a_plain_loop(spark):
    closes = [50 + 7 * math.sin(k / 2.3) + 3 * math.cos(k * 1.7) for k in range(40)]
    rows = I.indicators(bars(spark, closes), "rsi14").orderBy("bar").collect()
    ups = [max(b - a, 0.0) for a, b in zip(closes, closes[1:])]
    downs = [max(a - b, 0.0) for a, b in zip(closes, closes[1:])]
    up, down = sum(ups[:14]) / 14, sum(downs[:14]) / 14
    assert rows[13]["rsi14"] is None
    for k in range(14, 40):
        if k > 14:
            up, down = (up * 13 + ups[k - 1]) / 14, (down * 13 + downs[k - 1]) / 14
        assert rows[k]["rsi14"] == pytest.approx(100 * up / (up + down))


def test_health_of_the_last_trades_across_dates(spark):
    days = [0, 0, 0, 1, 2, 2, 2, 2, 5, 6, 6]
    r = [1.0, -2.0, 0.5, -1.0, 2.0, -0.5, -0.5, 1.5, -3.0, 0.25, 1.0]
    rows = [(1, k, d, x) for k, (d, x) in enumerate(zip(days, r))]
    trades = spark.createDataFrame(rows, "symbol_id long, signal_bar int, exit_date int, actual_rr double")
    for factor, minimum in ((False, 0.0), (True, 1.2)):
        got = {x["exit_date"]: (x["closed"], x["healthy"]) for x in T.health(trades, 4, minimum, factor).collect()}
        for day in set(days):
            past = [x for d, x in zip(days, r) if d <= day]
            last, lost = past[-4:], -sum(x for x in past[-4:] if x < 0)
            good = sum(last) / 4 >= minimum if not factor else (sum(x for x in last if x > 0) / lost >= minimum if lost else sum(last) > 0)
            assert got[day] == (len(past), len(past) < 4 or good)


def test_holidays_have_no_session(spark):
    times = spark.createDataFrame([("2026-01-23 06:00:00",), ("2026-01-26 06:00:00",), ("2026-01-27 06:00:00",)], "ts string")
    assert [x[0] for x in times.select(S.market_open(F.col("ts").cast("timestamp"))).collect()] == [True, False, True]


def test_flat_prices_have_a_neutral_rsi_and_the_range_as_atr(spark):
    last = I.indicators(bars(spark, [100.0] * 30, spread=1.0)).orderBy(F.desc("bar")).first()
    assert last["rsi14"] == 50.0 and last["atr14"] == 2.0 and last["ema21"] == pytest.approx(100.0)


def test_as_of_values_need_no_later_bar(spark):
    candles = fx.candles(spark, SF).filter("symbol_id = 3")
    whole = scans.crossover(*scans.features(candles)).filter("bar between 100 and 150").select("bar", "reason", "target", "score")
    short = scans.crossover(*scans.features(candles.filter("bar <= 150"))).filter("bar between 100 and 150").select("bar", "reason", "target", "score")
    assert whole.orderBy("bar").collect() == short.orderBy("bar").collect()


def test_zones_merge_within_two_percent_and_split_beyond(spark):
    prices = spark.createDataFrame([([100.0, 101.0, 101.9, 110.0],), ([],)], "p array<double>")
    merged, none = (r["z"] for r in prices.select(Z.cluster(F.col("p")).alias("z")).collect())
    assert [(z["low"], z["high"], z["touches"]) for z in merged] == [(100.0, 101.9, 3), (110.0, 110.0, 1)]
    assert none == []


def test_ties_are_no_extremes(spark):
    rows = I.extrema(bars(spark, [5.0, 4.0, 3.0, 3.0, 4.0, 5.0, 2.0, 6.0, 7.0])).filter("is_low").collect()
    assert [(r["low"], r["confirm_bar"]) for r in rows] == [(2.0, 9)]


def test_stop_wins_ties_and_trailing_stops_follow(spark):
    candles = bars(spark, [100.0] * 3).withColumn("high", F.lit(120.0)).withColumn("low", F.lit(80.0))
    signal = spark.createDataFrame([(1, 1, 2, 100.0, 90.0, 110.0, 2.0, 50.0)], "symbol_id long, signal_bar int, entry_bar int, entry double, sl double, target double, atr double, score double")
    signal = signal.withColumn("signal_date", F.lit(None).cast("date")).withColumn("entry_date", F.lit(None).cast("date"))
    row = L.barrier(signal, candles).first()
    assert (row["outcome"], row["exit_bar"], row["actual_rr"], row["hold_days"]) == ("loss", 2, -1.0, 1)


def test_loss_streaks_skip_timeouts(spark):
    kinds = [("loss", -1.0), ("timeout", 0.1), ("loss", -1.0), ("win", 2.0), ("loss", -1.0), ("trail_stop", -0.5), ("trail_stop", 0.5)]
    rows = [(k, 1, k, o, r) for k, (o, r) in enumerate(kinds)]
    trades = spark.createDataFrame(rows, "signal_bar int, symbol_id long, exit_date int, outcome string, actual_rr double")
    assert L.max_loss_streak(trades).first()[0] == 2


def test_streaks_and_new_symbols(spark):
    log = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)], "scanned_at int, symbol long")
    got = {(r["scanned_at"], r["symbol"]): (r["streak"], r["is_new"]) for r in logs.streaks(log).collect()}
    assert got == {(1, 1): (1, False), (1, 2): (1, False), (2, 1): (2, False), (3, 1): (3, False), (3, 2): (1, True)}


def test_upsert_takes_the_new_row(spark):
    old = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    new = spark.createDataFrame([(2, 21), (3, 31)], "k int, v int")
    assert sorted(map(tuple, logs.upsert(old, new, ["k"]).collect())) == [(1, 10), (2, 21), (3, 31)]
    assert sorted(map(tuple, logs.insert_ignore(old, new, ["k"]).collect())) == [(1, 10), (2, 20), (3, 31)]


def test_no_row_at_a_time_python_in_scans(spark):
    plan = scans.breakout(*scans.features(fx.candles(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_half_cents_round_away_from_zero():
    assert I.cents(1.005) == math.floor(100.49999999999999 + 0.5) / 100


def test_frames_decode_and_bad_ones_say_so():
    import struct

    from tidemark.sources.ticks import frame_packets

    packets = [struct.pack(">Ii", 7, -12345), struct.pack(">IiiiiiiI", 8, 100, 300, 50, 120, 110, 0, 99), bytes(184)]
    data = struct.pack(">H", len(packets)) + b"".join(struct.pack(">H", len(p)) + p for p in packets)
    got = list(frame_packets(data))
    assert (got[0]["token"], got[0]["last_price"], got[0]["tradable"]) == (7, -123.45, True)
    assert (got[1]["high"], got[1]["low"], got[1]["exchange_time"], got[1]["tradable"]) == (3.0, 0.5, 99, False)
    assert len(got[2]["bids"]) == len(got[2]["asks"]) == 5
    assert [p.get("error") for p in frame_packets(data[:-1])] == [None, None, "truncated"]
    assert list(frame_packets(b"\0")) == [] and list(frame_packets(None)) == []


def test_candle_files_are_named_after_their_symbol(spark, tmp_path):
    (tmp_path / "tcs.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,\"1,200\"\n2024-01-03,1,2,x,1.5,7\n")
    (tmp_path / "m&m.ns.csv").write_text("date,open,high,low,close,volume\n1/4/2024,3,4,2,3.5,9\n")
    good, bad = read_candles_csv(spark, str(tmp_path))
    assert sorted((r.symbol, str(r.ts), r.volume) for r in good.collect()) == [("M&M.NS", "2024-01-04 00:00:00", 9), ("TCS", "2024-01-02 00:00:00", 1200)]
    (reject,) = bad.collect()
    assert reject.symbol == "TCS" and reject.file.endswith("/tcs.csv") and (reject.line, reject.reason) == (3, "low") and ",x," in reject.text


def test_candle_files_have_their_own_headers_and_lines(spark, tmp_path):
    """A folder of files in other orders of columns, one of them over many splits, one without a column."""
    (tmp_path / "a.csv").write_text("Date,Low,High,Open,Close,Volume\n2024-01-02,0.5,2,1,1.5,10\n")
    (tmp_path / "b.csv").write_text("volume , note,DATE,close,open,high,low\n\n\"1,300\",\"x, y\",2024-01-02,1.5,1,2,0.5\n7,,2024-13-02,1.5,1,2,0.5\n")
    (tmp_path / "c.csv").write_text("Date,Open,High,Low,Volume\n2024-01-02,1,2,0.5,10\n")
    rows = [f"2024-01-02,{k}.25,{k + 1},{k},{k}.5,{'' if k % 700 == 699 else k}" for k in range(5000)]
    (tmp_path / "d.csv").write_text("\n".join(["Date,Open,High,Low,Close,Volume", *rows]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "8192")
        good, bad = read_candles_csv(spark, str(tmp_path))
        found, rejects = good.collect(), bad.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.symbol, r.open, r.high, r.low, r.close, r.volume) for r in found if r.symbol != "D") == [("A", 1.0, 2.0, 0.5, 1.5, 10), ("B", 1.0, 2.0, 0.5, 1.5, 1300)]
    assert sorted(r.volume for r in found if r.symbol == "D") == [k for k in range(5000) if k % 700 != 699]
    assert all(r.low == r.volume and r.open == r.volume + 0.25 for r in found if r.symbol == "D")
    assert sorted((r.symbol, r.line, r.reason) for r in rejects) == sorted([("B", 3, "ts"), ("C", 1, "missing close"), *(("D", k + 2, "volume") for k in range(699, 5000, 700))])
