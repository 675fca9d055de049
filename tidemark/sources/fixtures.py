"""Tables derived from the driver's: candles from lineitem, logs and ticks from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task of candles is dealt, about.
TASK_ROWS = 500_000


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol_id, d, bar, open, high, low, close, volume): a symbol per supplier, a bar per ship date.

    One shuffle, by symbol, into partitions that grow in number with the items, so that a task's
    don't in size; it serves the days, the windows here and all further work by symbol.
    """
    items = table(spark, sf_dir, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), items.count() // TASK_ROWS + 1)
    points = items.select(
        F.col("l_suppkey").alias("symbol_id"), F.col("l_shipdate").cast("date").alias("d"), (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("disc"),
        (F.round(F.col("l_tax") * 100).cast("int") - 4).alias("tax"), F.col("l_quantity").alias("quantity"),
    )
    day = points.repartition(parts, "symbol_id").groupBy("symbol_id", "d").agg(F.sum("disc").alias("disc_pts"), F.sum("tax").alias("tax_pts"), F.sum("quantity").cast("long").alias("qty"))
    by_day = W.partitionBy("symbol_id").orderBy("d")
    ranked = day.withColumn("cum", F.sum("disc_pts").over(by_day.rowsBetween(W.unboundedPreceding, 0))).withColumn("bar", F.row_number().over(by_day))
    cents = lambda log: F.round(F.lit(10000) * F.exp(log / F.lit(10000.0))) / 100
    priced = ranked.withColumn("close", cents(60 * F.col("cum") + 4 * F.col("bar"))).withColumn("open", cents(60 * (F.col("cum") - F.col("disc_pts")) + 4 * (F.col("bar") - 1) + 5 * F.col("tax_pts")))
    return priced.select(
        "symbol_id", "d", "bar", "open",
        (F.round(F.greatest("open", "close") * (10000 + 2 * (F.col("qty") % 50)) / F.lit(100.0)) / 100).alias("high"),
        (F.round(F.least("open", "close") * (10000 - 2 * ((F.col("qty") * 7) % 50)) / F.lit(100.0)) / 100).alias("low"),
        "close", (F.col("qty") * 1000).alias("volume"),
    )


def _mean_close(rows: DataFrame, *keys: str) -> DataFrame:
    cents = F.sum(F.round(F.col("close") * 100).cast("long"))
    return rows.groupBy(*keys).agg((F.round(cents / F.count("*")) / 100).alias("close"))


def bench_index(rows: DataFrame) -> DataFrame:
    """(d, close): the mean close of all symbols on each date."""
    return _mean_close(rows, "d")


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol_id, sector): supplier to region."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_suppkey").alias("symbol_id"), F.col("n_regionkey").cast("int").alias("sector"))


def sector_index(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """(sector, d, close) without Saturdays and Sundays, so that dates are missing."""
    return _mean_close(rows.join(sectors, "symbol_id").filter(F.weekday("d") < 5), "sector", "d")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, ts, last_price, qty, seq) from events."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("token"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("last_price"),
        F.get_json_object("props", "$.k").cast("long").alias("qty"), F.col("event_id").cast("long").alias("seq"),
    )


def quotes(ticks: DataFrame, rows: DataFrame) -> DataFrame:
    """(token, ts, seq, last_price, open, high, low, volume): ticks as moves of up to 4 % from their symbol's last close, some without an open."""
    last = rows.groupBy(F.col("symbol_id").alias("token")).agg(F.max_by("close", "d").alias("close"))
    price = F.round(F.col("close") * (100 + (F.col("last_price") % 7 - 3))) / 100
    moved = ticks.join(last, "token").withColumn("price", price)
    return moved.select(
        "token", "ts", "seq", F.col("price").alias("last_price"), F.when(F.col("qty") >= 10, F.col("close")).alias("open"), F.greatest("close", "price").alias("high"),
        F.least("close", "price").alias("low"), (F.col("qty") * 1000).alias("volume"),
    )


def scan_log(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """(scanned_at, symbol, score): a run for each hour or day, a row for each user seen in it."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("scanned_at"), F.col("user_id").cast("long").alias("symbol"))
        .agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("score"))
    )


def batches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candles up to 1996, and those from 1996 on a cent higher."""
    return rows.filter("d < date'1997-01-01'"), rows.filter("d >= date'1996-01-01'").withColumn("close", F.round(F.col("close") * 100 + 1) / 100)
