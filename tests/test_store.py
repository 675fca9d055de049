"""The candle store: what a range reads, and which files a write touches."""

import datetime as dt
import os
import random

import pytest

from tidemark.sources import snapshots
from tidemark.sources.store import CandleStore

SCHEMA = "symbol_id long, d date, bar int, open double, high double, low double, close double, volume long"


def rows_of(symbols, days, close):
    return [(s, dt.date(2023, 1, 1) + dt.timedelta(k), k + 1, 1.0, 2.0, 0.5, close, 10) for s in symbols for k in days]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def content(store, spark):
    return {(r["symbol_id"], r["d"]): r["close"] for r in store.read(spark).collect()}


@pytest.fixture
def store(spark, tmp_path):
    store = CandleStore(f"{tmp_path}/candles", buckets=4)
    store.create(spark.createDataFrame(rows_of(range(20), range(120), 1.0), SCHEMA))
    return store


def test_a_range_opens_its_months_and_bucket(spark, store):
    found = store.range(spark, 7, "2023-02-10", "2023-03-05", 100)
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "month" in parts and "bucket" in parts
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "EqualTo(symbol_id,7)" in pushed and "GreaterThanOrEqual(d,2023-02-10)" in pushed and "LessThanOrEqual(d,2023-03-05)" in pushed
    assert [r["d"] for r in found.collect()] == [dt.date(2023, 2, 10) + dt.timedelta(k) for k in range(24)]
    assert [r["bar"] for r in store.range(spark, 7, limit=3).collect()] == [1, 2, 3] and store.range(spark, 99).count() == 0
    assert store.range(spark, since="2023-04-30").count() == 20


@pytest.mark.parametrize(("write", "close"), [("upsert", 9.0), ("insert_ignore", 1.0)])
def test_a_write_touches_its_partitions_only(spark, store, write, close):
    before, old = files(store.path), content(store, spark)
    new = rows_of([3], range(40, 45), 9.0) + rows_of([3, 3], range(130, 132), 9.0) + rows_of([25], [40], 9.0)
    getattr(store, write)(spark.createDataFrame(new, SCHEMA))
    after = files(store.path)
    months = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert months and all("month=202302" in m or "month=202305" in m for m in months) and len({m for m in months if "202302" in m}) <= 2
    assert all(after[f] == at for f, at in before.items() if os.path.dirname(f) not in months)
    want = dict(old) | {(s, d): close for s, d, *_ in rows_of([3], range(40, 45), 0)} | {(s, d): 9.0 for s, d, *_ in rows_of([3], range(130, 132), 0) + rows_of([25], [40], 0)}
    assert content(store, spark) == want and store.read(spark).count() == len(want)


def test_random_writes_equal_a_dictionary(spark, store):
    rnd, want = random.Random(1), content(store, spark)
    for k in range(4):
        new = [rows_of([rnd.randrange(25)], [rnd.randrange(150)], float(k + 2))[0] for _ in range(60)]
        new = list({r[:2]: r for r in new}.values())
        wins = k % 2 == 0
        (store.upsert if wins else store.insert_ignore)(spark.createDataFrame(new, SCHEMA))
        fresh = {r[:2]: r[6] for r in new}
        want = want | fresh if wins else fresh | want
        assert content(store, spark) == want
    store.upsert(spark.createDataFrame([], SCHEMA))
    assert content(store, spark) == want


def test_purged_days_are_gone(spark, store):
    store.purge(spark, "2023-03-15")
    assert not any("month=202301" in f or "month=202302" in f for f in files(store.path))
    assert min(d for _, d in content(store, spark)) == dt.date(2023, 3, 15) and len(content(store, spark)) == 20 * (120 - 73)


def test_one_of_two_writers_commits_a_date(spark, tmp_path, monkeypatch):
    path, state = f"{tmp_path}/state", lambda x: spark.createDataFrame([(1, x)], "symbol_id long, close double")
    kept = lambda: sorted((str(r["as_of"]), r["close"]) for r in spark.read.parquet(path).collect())
    snapshots.write_snapshot(state(1.0), path, "2024-01-02")
    for late in ("2024-01-02", "2024-01-01"):
        with pytest.raises(snapshots.AlreadyProcessed):
            snapshots.write_snapshot(state(2.0), path, late)
    create = snapshots._Files.names

    def overtaken(files, name):  # another writer commits after this one has looked
        found = create(files, name)
        if name == snapshots.COMMITS and not raced:
            raced.append(1)
        elif name == snapshots.COMMITS and len(raced) == 1:
            raced.append(2)
            snapshots.write_snapshot(state(3.0), path, "2024-01-03")
        return found

    raced = []
    monkeypatch.setattr(snapshots._Files, "names", overtaken)
    with pytest.raises(snapshots.AlreadyProcessed):
        snapshots.write_snapshot(state(4.0), path, "2024-01-03")
    monkeypatch.undo()
    assert kept() == [("2024-01-02", 1.0), ("2024-01-03", 3.0)]
    settle = snapshots._settle

    def lost(files, last, commit):
        if commit.endswith("2024-01-04"):
            raise OSError("lost")
        settle(files, last, commit)

    monkeypatch.setattr(snapshots, "_settle", lost)
    with pytest.raises(OSError):
        snapshots.write_snapshot(state(5.0), path, "2024-01-04")
    monkeypatch.undo()
    snapshots.write_snapshot(state(6.0), path, "2024-01-05")  # finishes what the one before left
    snapshots.write_snapshot(state(7.0), path, "2024-01-03", force=True)
    assert kept() == [("2024-01-02", 1.0), ("2024-01-03", 7.0), ("2024-01-04", 5.0), ("2024-01-05", 6.0)]
    assert snapshots.last_commit(spark, path)[1] == "2024-01-05"


def test_purged_dates_of_a_log_are_gone(spark, tmp_path):
    path, start = f"{tmp_path}/log", dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=6 * k), k, (start + dt.timedelta(hours=6 * k)).date()) for k in range(40)]
    spark.createDataFrame(rows, "scanned_at timestamp, symbol long, scan_date date").write.partitionBy("scan_date").parquet(path)
    counts = snapshots.purge_log(spark, path, "2024-01-04 09:00:00").collect()[0]
    assert tuple(counts) == (26, 14) and sorted(r["symbol"] for r in spark.read.parquet(path).collect()) == list(range(14, 40))
    assert not any(f"scan_date=2024-01-0{k}" in f for f in files(path) for k in (1, 2, 3))
