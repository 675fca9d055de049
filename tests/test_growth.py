"""What grows with the input: partitions, shuffles of bars, looks at a state, joins of files."""

import datetime as dt
import re
from itertools import pairwise

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import indicators as I
from tidemark.operators import scans
from tidemark.operators import state as S
from tidemark.operators import zones as Z
from tidemark.plans import queries_last
from tidemark.sources import fixtures as fx
from tidemark.sources import readers as R
from tidemark.sources import shared
from tidemark.sources import store as store_module
from tidemark.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_of_candles_grow_with_the_items(spark, monkeypatch):
    monkeypatch.setattr(fx, "TASK_ROWS", 500)
    plan = plan_of(fx.candles(spark, SF))
    assert re.findall(r"hashpartitioning\(symbol_id#\d+L?, (\d+)\)", plan) == [str(fx.table(spark, SF, "lineitem").count() // 500 + 1)]


def test_writes_of_the_store_grow_with_its_rows(spark, monkeypatch, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(store_module, "TASK_ROWS", 100)
    assert store_module._tasks(spark.read.parquet(f"{tmp_path}/rows")) == 11


def test_no_frame_ends_at_the_last_row(spark):
    plan = plan_of(entry.queries()["next_session"](spark, SF))
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_strength_moves_no_bars(spark):
    day = dt.date(2024, 1, 1)
    rows = spark.createDataFrame([(1, day, 21, 3.0, 2.0), (2, day, 21, 3.0, None)], "symbol_id long, d date, bar int, close double, close20 double")
    bench = spark.createDataFrame([(day - dt.timedelta(k), 1.0) for k in range(30)], "d date, close double")
    found = scans.with_strength(rows, bench, spark.createDataFrame([(1, 7)], "symbol_id long, sector int"), spark.createDataFrame([(7, day, 4.0)], "sector int, d date, sector_ret double"))
    assert {r["symbol_id"]: (r["gained"], r["sector_gained"]) for r in found.collect()} == {1: (50.0, 4.0), 2: (None, None)}
    assert "SortMergeJoin" not in plan_of(found)


def test_counted_zones_are_those_of_each_bar(spark):
    prices = [10.0, 10.1, 12.0, 9.0, 12.1, 10.2, 15.0, 9.1]
    lows = [(p, k + 3) for k, p in enumerate(prices)]
    extremes = spark.createDataFrame([(1, sorted(lows), [])], "symbol_id long, lows array<struct<price:double,confirm_bar:int>>, highs array<struct<price:double,confirm_bar:int>>")
    rows = spark.createDataFrame([(1, b) for b in range(1, 13)] + [(2, 5)], "symbol_id long, bar int")
    each = rows.join(extremes, "symbol_id").select("bar", F.inline(Z.zones_asof("lows", F.col("bar"))))
    want = {tuple(r) for r in each.groupBy("bar").agg(F.count("*"), F.sum("touches"), F.min("low"), F.max("high")).collect()}
    got = Z.counted(rows, extremes).collect()
    assert {(r["bar"], r["n"], r["touches"], r["lowest"], r["highest"]) for r in got} == want and all(r["kind"] == "low" and r["symbol_id"] == 1 for r in got) and len(want) == 10


def test_a_streak_takes_one_look_and_one_change_a_batch():
    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    keeper = J._Streaks(1)
    keeper.last = State()
    first = pd.concat(keeper.handleInputRows((5,), iter([pd.DataFrame({"day": [3, 1], "score": [30, 10]}), pd.DataFrame({"day": [2, 7], "score": [20, 70]})]), None))
    assert first[["day", "score", "streak"]].values.tolist() == [[1, 10, 1], [2, 20, 2], [3, 30, 3], [7, 70, 1]] and keeper.last.calls == 2
    assert pd.concat(keeper.handleInputRows((5,), iter([pd.DataFrame({"day": [8], "score": [1]})]), None))["streak"].tolist() == [2]


def test_lines_of_many_small_files_are_joined_to_nothing(spark, monkeypatch, tmp_path):
    """Files of one split have their numbers from the task that reads them, however many they are."""
    for k in range(6):
        (tmp_path / f"S{k}.csv").write_text("Date,Close\n" + "".join(f"{j},x\n\n" for j in range(k)))
    monkeypatch.setattr(R, "BROADCAST_BLOCKS", 2)
    lines = R.numbered_lines(spark, str(tmp_path))
    assert "SortMergeJoin" not in plan_of(lines)
    assert sorted((r["file"][-6:], r["line"], r["header"]) for r in lines.collect()) == [(f"S{k}.csv", n, "Date,Close") for k in range(6) for n in range(1, k + 2)]


def test_places_go_on_over_batches():
    batch = lambda rows: pa.RecordBatch.from_pylist([{"file": f, "block": b, "text": t} for f, b, t in rows], pa.schema([("file", pa.string()), ("block", pa.int64()), ("text", pa.string())]))
    batches = [batch([("a", 0, "h"), ("a", 0, "x")]), batch([]), batch([("a", 0, "y"), ("a", 9, "z"), ("b", 0, "k")]), batch([("b", 0, "l"), ("b", 0, "m")])]
    got = [tuple(r.values()) for b in R._places(iter(batches)) for r in b.to_pylist()]
    assert [(f, b, p, h) for f, b, p, h, _ in got] == [("a", 0, 1, "h"), ("a", 0, 2, "h"), ("a", 0, 3, "h"), ("a", 9, 1, "z"), ("b", 0, 1, "k"), ("b", 0, 2, "k"), ("b", 0, 3, "k")]


@pytest.mark.parametrize("text", ["2024-01-02", " 2024-01-02 ", "2024-01-02 03:04:05", "2024-01-02T03:04:05+05:30", "2024-01-02T03:04:05Z", "1/2/2024 3:04:05", "1/2/2024", "12/31/2024", "n/a", "", "2024-13-01", "1-2-2024", None])
def test_a_time_is_that_of_all_layouts_tried(spark, text):
    row = spark.createDataFrame([(text,)], "t string")
    tried = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(layout)) for layout in R.DATE_LAYOUTS])
    got, want = row.select(R.parsed_time(F.col("t")), tried).collect()[0]
    assert got == want


ODD_FILES = {
    "a.csv": b"\xef\xbb\xbfDate,Open,High,Low,Close,Volume\r\n2024-01-02,1,2,0.5,1.5,10\r\n\r\n   \r\n1/3/2024, 1.25 ,+2,.5,1e1,\"1,300\"\r\n",
    "b&b.ns.csv": b'volume , note,DATE,close,open,high,low\n"1,300" , "x, ""y""",2024-01-02T03:04:05+05:30,1.5,1,2,0.5,more\n"1"2,,2024-01-02,1.5,1,2,0.5\n7,"open,2024-01-02,1.5,1,2,0.5\n8,,1/2/2024 3:04:05,NaN,1,2,0.5\n9,"a\\"b, c",2024-01-02 03:04:05,1.5,1,2,0.5\n',
    "c.csv": b"Date,Open,High,Low,Volume\n2024-01-02,1,2,0.5,10\n2024-01-02,1,2,0.5,10\n",
    "d.csv": b"Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5\n2024-13-02,1,2,0.5,1.5,1\n2024-01-02,1,2,x,1.5,1\n2024-01-02,1,2,1,1.5,0x10\n2024-01-02,1,2,1,1.5,1.5\n2024-01-02,1,2,1,1.5,99999999999999999999\n2024-01-02,1,2,1,1.5,-7",
    "e.csv": b"",
    "f.csv": b"Date,Open,High,Low,Close,Volume\n",
}


@pytest.mark.parametrize("whole", [4 << 20, -1])
def test_odd_candle_files_are_judged_alike_whole_and_by_line(spark, monkeypatch, tmp_path, whole):
    import gzip

    for name, content in ODD_FILES.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(ODD_FILES["d.csv"].split(b"\n")[0] + b"\n2024-01-02,1,2,0.5,1.5,11\n"))
    (tmp_path / "symbol=h").mkdir()
    monkeypatch.setattr(R, "WHOLE_BYTES", whole)
    rows = R.judged_candles_csv(spark, str(tmp_path)).collect()
    good = sorted((r["symbol"], r["line"], str(r["ts"]), r["open"], r["high"], r["low"], str(r["close"]), r["volume"]) for r in rows if r["reason"] is None)
    assert good == [
        ("A", 2, "2024-01-02 00:00:00", 1.0, 2.0, 0.5, "1.5", 10), ("A", 3, "2024-01-03 00:00:00", 1.25, 2.0, 0.5, "10.0", 1300),
        ("B&B.NS", 2, "2024-01-01 21:34:05", 1.0, 2.0, 0.5, "1.5", 1300), ("B&B.NS", 5, "2024-01-02 03:04:05", 1.0, 2.0, 0.5, "nan", 8), ("B&B.NS", 6, "2024-01-02 03:04:05", 1.0, 2.0, 0.5, "1.5", 9),
        ("D", 8, "2024-01-02 00:00:00", 1.0, 2.0, 1.0, "1.5", -7), ("G", 2, "2024-01-02 00:00:00", 1.0, 2.0, 0.5, "1.5", 11),
    ]
    assert all((r["file"] is None) == (r["text"] is None) == (r["reason"] is None) for r in rows)
    bad = sorted((r["symbol"], r["line"], r["reason"], r["file"].rsplit("/")[-1]) for r in rows if r["reason"])
    assert bad == [("B&B.NS", 3, "volume", "b&b.ns.csv"), ("B&B.NS", 4, "ts", "b&b.ns.csv"), ("C", 1, "missing close", "c.csv"), ("D", 2, "volume", "d.csv"), ("D", 3, "ts", "d.csv"), ("D", 4, "low", "d.csv"), ("D", 5, "volume", "d.csv"), ("D", 6, "volume", "d.csv"), ("D", 7, "volume", "d.csv")]


@pytest.mark.parametrize("text", ["2024-01-02", "2024-02-30", "2024-01-02 03:04:05", "2024-01-02 24:00:00", "1/2/2024 3:04:05", "01/02/2024 23:59:59", "1/2/2024", "12/31/2024", "13/1/2024", "2/29/2023", "1500-01-01", "2024-1-2", "n/a", ""])
def test_a_plain_time_is_that_of_the_layouts(spark, text):
    want = spark.createDataFrame([(text,)], "t string").select(R.parsed_time(F.col("t")).cast("timestamp_ntz")).collect()[0][0]
    assert R._clock(text) == want


def test_small_files_are_read_once_and_written_nowhere(spark, monkeypatch):
    monkeypatch.setattr(R, "written", lambda df, name: pytest.fail(f"writes {name}"))
    for name in ("src_candles_csv_dir", "src_candles_csv"):
        plan = plan_of(entry.queries()[name](spark, SF))
        assert plan.count("FileScan") == 1 and "from_csv" not in plan


def test_files_of_no_mounted_folder_are_written_by_spark(spark, monkeypatch):
    found = [sorted(map(tuple, entry.queries()["src_candles_csv_dir"](spark, SF).collect()))]
    monkeypatch.setattr(queries_last, "mounted", lambda spark, path: None)
    found.append(sorted(map(tuple, entry.queries()["src_candles_csv_dir"](spark, SF).collect())))
    assert found[0] == found[1] and len(found[0]) == 10


def test_texts_of_a_symbol_are_one_file_over_batches(tmp_path):
    batches = [pa.RecordBatch.from_pydict({"symbol": s, "text": t}, pa.schema([("symbol", pa.string()), ("text", pa.string())])) for s, t in ((["a", "a"], ["1\n", "2\n"]), ([], []), (["a", "b"], ["3\n", "é\n"]), (["c"], ["5\n"]))]
    for _ in range(2):
        assert [b.to_pydict() for b in shared.write_texts(str(tmp_path / "x"), ".csv", iter([batches[0], *batches[1:]]))] == [{"files": [3]}]
        assert {f.name: f.read_text() for f in (tmp_path / "x").iterdir()} == {"a.csv": "1\n2\n3\n", "b.csv": "é\n", "c.csv": "5\n"}


def test_a_slice_of_texts_takes_little_memory_to_fit():
    import random
    import tracemalloc

    import numpy as np

    from tidemark.llm import languages

    rnd = random.Random(1)
    text = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=2000))
    model = languages.Model(tuple("abcde"), np.full((languages.BUCKETS, 5), 1 / languages.BUCKETS, np.float32))
    tracemalloc.start()
    languages.fitted([text] * (languages.SLICE // 2000), model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20


def closed_values(bars):
    """The state after some closed bars of one symbol, by loops."""
    low, high, close = bars["low"], bars["high"], bars["close"]
    changes = [b - a for a, b in pairwise(close)]
    spans = [max(h - x, abs(h - c), abs(c - x)) for h, x, c in zip(high[1:], low[1:], close)]
    steps = {"atr14": spans} | {f"{kind}{p}": [max(sign * c, 0.0) for c in changes] for p in I.RSIS for kind, sign in (("gain", 1), ("loss", -1))}
    averages = {f"ema{p}": I.ema(close, p) for p in I.EMAS}
    total = 0.0
    for v in close:
        total += v
    state = {"bar": len(close), "close": close[-1] if close else None, "total": total} | {n: v[-1] if v else None for n, v in averages.items()}
    for name, values in steps.items():
        p, so_far = S._period(name), 0.0
        for v in values[: p - 1]:
            so_far += v
        state[name] = I.wilder(values, p)[-1] if len(values) >= p else so_far
    of = {"volumes": bars["volume"], "closes": close, "past_ema200": averages["ema200"], "last_lows": low, "last_highs": high}
    state |= {name: of[name][-n:] for name, n in S.RECENT.items()}
    for name, v in (("lows", low), ("highs", [-x for x in high])):
        found = [i for i in range(2, len(v) - 2) if v[i] < min(v[i - 2 : i]) and v[i] < min(v[i + 1 : i + 3])]
        state[name] = sorted(({"price": abs(v[i]), "confirm_bar": i + 3} for i in found), key=lambda x: (x["price"], x["confirm_bar"]))
    return state


def test_states_of_many_symbols_are_those_of_each(spark, monkeypatch):
    """One step a bar for all symbols of a group: as many steps for 40 symbols as for the longest of them."""
    import random

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(S.SCHEMA))
    rnd, rows, want = random.Random(5), [], {}
    for symbol, size in enumerate([1, 2, 3, 5, 6, 14, 15, 16, 21, 200, 201, 202, 230, *range(7, 34)]):
        price, bars = 100.0, []
        for k in range(size):
            price = round(price + rnd.choice([-1.0, -0.5, 0.0, 0.5, 1.0]), 2)
            bars.append({"symbol_id": symbol, "d": dt.date(2024, 1, 1) + dt.timedelta(k), "bar": k + 1, "open": price, "high": price + rnd.choice([0.0, 0.5, 1.0]), "low": price - rnd.choice([0.0, 0.5]), "close": price, "volume": rnd.randrange(1000)})
        rows += bars
        want[symbol] = closed_values({c: [b[c] for b in bars[:-1]] for c in bars[0]}) | {"symbol_id": symbol, "live": {c: bars[-1][c] for c in S.BAR_FIELDS}}
    rnd.shuffle(rows)
    steps = []
    final = I.Matrix.final
    monkeypatch.setattr(I.Matrix, "final", lambda self, values, *more: steps.append(self.shape[0]) or final(self, values, *more))
    got = S.states(pa.Table.from_pylist(rows), kinds).to_pylist()
    assert {r["symbol_id"]: r for r in got} == want and len(got) == 40
    assert steps == [229] * 12
    only = S.states(pa.Table.from_pylist([r for r in rows if r["symbol_id"] == 0]), kinds).to_pylist()
    assert only == [want[0]]


def test_extremes_known_before_the_first_bar_are_dealt_at_once(spark, monkeypatch):
    prices = [10.0, 10.1, 12.0, 9.0, 12.1, 10.2, 15.0, 9.1, 9.1, 11.0, 11.3, 30.0]
    added, dealt = Z.Levels(), Z.Levels()
    for p in prices:
        added.add(p)
    monkeypatch.setattr(Z.Levels, "add", lambda self, price: pytest.fail("one by one"))
    dealt.extend(prices)
    assert (dealt.zones, dealt.lows, dealt.highs) == (added.zones, added.lows, added.highs)
    dealt.extend(prices[:6])
    monkeypatch.undo()
    for p in prices[:6]:
        added.add(p)
    dealt.extend([9.9])
    added.add(9.9)
    assert (dealt.zones, dealt.lows, dealt.highs) == (added.zones, added.lows, added.highs)


def test_nearest_zones_of_many_symbols_are_those_of_each_bar(spark):
    import random

    rnd, kind = random.Random(3), "array<struct<price:double,confirm_bar:int>>"
    known = [(s, sorted((round(rnd.uniform(80, 120), 2), rnd.randrange(3, 60)) for _ in range(s * 3)), sorted((round(rnd.uniform(80, 120), 2), rnd.randrange(3, 60)) for _ in range(40 - s))) for s in range(8)]
    extremes = spark.createDataFrame(known, f"symbol_id long, lows {kind}, highs {kind}")
    rows = spark.createDataFrame([(s, b, round(rnd.uniform(85, 115), 2)) for s in range(10) for b in range(1, 64, 7)], "symbol_id long, bar int, close double")
    got = Z.with_nearest(rows, extremes, F.col("bar") > 8, 2, 1.0).select("symbol_id", "bar", "support", "resistance")
    by_bar = rows.join(extremes, "symbol_id", "left")
    lows, highs = (F.coalesce(Z.zones_asof(c, F.col("bar")), F.array().cast(f"array<{Z.ZONE}>")) for c in ("lows", "highs"))
    support, resistance = Z.nearest_below(lows, F.col("close")), Z.nearest_above(highs, F.col("close"), 2, F.col("close") * (1 + 1.0 / 100))
    want = by_bar.select("symbol_id", "bar", F.when(F.col("bar") > 8, support).alias("support"), F.when(F.col("bar") > 8, resistance).alias("resistance"))
    assert {r[:2]: r for r in got.collect()} == {r[:2]: r for r in want.collect()}


def test_levels_are_all_zones_of_the_last_bar(spark):
    zones = sorted(tuple(r) for r in entry.queries()["zones_latest"](spark, SF).select("symbol_id", "low", "high", "mid", "touches").collect())
    levels = entry.queries()["levels"](spark, SF).collect()
    assert sorted((r["symbol_id"], r["low"], r["high"], r["mid"], r["touches"]) for r in levels) == zones
    ranks = {}
    for r in levels:
        ranks.setdefault((r["symbol_id"], r["side"]), []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values()) and max(map(len, ranks.values())) > 5


@pytest.mark.parametrize("name", ["scan_swing", "scan_breakout", "scan_crossover"])
def test_a_sorted_scan_finds_its_zones_once(spark, name):
    assert "FlatMapCoGroups" not in plan_of(entry.queries()[name](spark, SF))


def test_the_verdict_reads_the_items_once(spark):
    assert "lineitem" not in plan_of(entry.queries()["excess_verdict"](spark, SF))


def test_the_batches_of_a_live_scan_make_no_candles(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(J, "drain", lambda stream, *more: seen.append(stream._jdf.queryExecution().logical().toString()) or spark.createDataFrame([], "batch int, scanned_at timestamp, distance_pct double, score double, rs double"))
    entry.queries()["stream_live_scan"](spark, SF)
    assert "l_suppkey" not in seen[0] and "symbol_id" in seen[0]
