"""Queries on the log of scan runs, and candle stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it doesn't have."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: that of new, if it has one."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_batch")))).filter("_rank = 1").drop("_rank", "_batch")


def streaks(log: DataFrame) -> DataFrame:
    """log with streak (runs in a row that have the symbol) and is_new (it wasn't in the run before; never in the first).

    Runs are numbered once, from their distinct times; islands are per symbol.
    """
    runs = log.select("scanned_at").distinct().withColumn("run", F.row_number().over(W.orderBy("scanned_at")))
    rows = log.join(F.broadcast(runs), "scanned_at") if runs.limit(100_001).count() <= 100_000 else log.join(runs, "scanned_at")
    by_run = W.partitionBy("symbol").orderBy("run")
    island = F.col("run") - F.row_number().over(by_run)
    rows = rows.withColumn("island", island)
    streak = F.row_number().over(W.partitionBy("symbol", "island").orderBy("run"))
    return rows.withColumn("streak", streak.cast("long")).withColumn("is_new", (F.col("streak") == 1) & (F.col("run") > 1)).drop("run", "island")


def log_query(log: DataFrame, symbol: int | None = None, since: str | None = None, until: str | None = None, min_score: int | None = None, min_streak: int | None = None, limit: int = 100) -> DataFrame:
    """The latest rows that pass the filters which are given, best score first within a run."""
    tests = [(symbol, F.col("symbol") == symbol), (since, F.col("scanned_at") >= F.lit(since).cast("timestamp")), (until, F.col("scanned_at") <= F.lit(until).cast("timestamp")), (min_score, F.col("score") >= min_score), (min_streak, F.col("streak") >= min_streak if "streak" in log.columns else F.lit(True))]
    for given, test in tests:
        log = log if given is None else log.filter(test)
    return log.orderBy(F.desc("scanned_at"), F.desc("score"), "symbol").limit(limit)


def first_appearance(log: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """The earliest row of each symbol on each day of the zone."""
    day = F.from_utc_timestamp("scanned_at", zone).cast("date")
    return log.withColumn("day", day).groupBy("symbol", "day").agg(F.min(F.struct("scanned_at", "score")).alias("x")).select("symbol", "day", "x.*")


def latest_run(log: DataFrame, day: str | None = None, zone: str = "Asia/Kolkata") -> DataFrame:
    """Rows of the last run of a day of the zone, of the log's last day if none is given; none if the day had no run."""
    rows = log if day is None else log.filter(F.from_utc_timestamp("scanned_at", zone).cast("date") == F.lit(day).cast("date"))
    last = rows.agg(F.max("scanned_at").alias("scanned_at"))
    return rows.join(F.broadcast(last), "scanned_at")
