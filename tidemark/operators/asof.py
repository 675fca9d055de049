"""As-of joins: the last row of a slow series at or before each row of a fast one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .indicators import by_bar


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """left with values of the last right row of its keys at or before its time, null where there is none.

    Both sides are one stream in time order, right rows first among equals: a single shuffle on the
    keys, no range join.
    """
    packed = F.struct(*values)
    both = left.withColumn("_side", F.lit(1)).withColumn("_right", F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType))
    rows = both.unionByName(right.select(*keys, time, F.lit(0).alias("_side"), packed.alias("_right")), allowMissingColumns=True)
    seen = F.last("_right", ignorenulls=True).over(W.partitionBy(*keys).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_seen", seen).filter("_side = 1").select(*left.columns, *[F.col("_seen")[v].alias(v) for v in values])


def with_return(rows: DataFrame, lookback: int, *keys: str, order: str = "d", name: str = "ret") -> DataFrame:
    """rows with the percent return over lookback rows, null without as many before."""
    base = F.lag("close", lookback).over(W.partitionBy(*keys).orderBy(order) if keys else W.partitionBy(F.lit(0)).orderBy(order))
    return rows.withColumn(name, F.when(base > 0, (F.col("close") - base) / base * 100))


def relative_strength(candles: DataFrame, bench: DataFrame, lookback: int = 20) -> DataFrame:
    """(symbol_id, d, stock_ret, bench_ret, outperformance) of each bar against the benchmark as of its date.

    The benchmark has a row per date, so it is small: it is ranked once and joined by as-of on a
    constant key with the last known return.
    """
    stock = candles.withColumn("stock_ret", F.when(F.lag("close", lookback).over(by_bar()) > 0, (F.col("close") - F.lag("close", lookback).over(by_bar())) / F.lag("close", lookback).over(by_bar()) * 100))
    known = with_return(bench, lookback, name="bench_ret").select("d", "bench_ret")
    dates = candles.select("d").distinct().withColumn("k", F.lit(1))
    per_date = asof(dates, known.withColumn("k", F.lit(1)), ["k"], "d", ["bench_ret"]).drop("k")
    return _outperformance(stock.join(per_date, "d"))


def sector_strength(candles: DataFrame, sectors: DataFrame, sector_index: DataFrame, bench: DataFrame, lookback: int = 20) -> DataFrame:
    """As relative_strength, of each symbol's sector index against the benchmark, both as of the bar's date."""
    known = with_return(sector_index, lookback, "sector", name="stock_ret").select("sector", "d", "stock_ret")
    days = candles.join(sectors, "symbol_id").select("symbol_id", "sector", "d", "bar")
    per_day = asof(days.select("sector", "d").distinct(), known, ["sector"], "d", ["stock_ret"])
    market = with_return(bench, lookback, name="bench_ret").select(F.lit(1).alias("k"), "d", "bench_ret")
    per_date = asof(days.select("d").distinct().withColumn("k", F.lit(1)), market, ["k"], "d", ["bench_ret"]).drop("k")
    return _outperformance(days.join(per_day, ["sector", "d"]).join(per_date, "d"))


def _outperformance(rows: DataFrame) -> DataFrame:
    return rows.withColumn("outperformance", F.col("stock_ret") - F.col("bench_ret"))


def net(price: Column, base: Column) -> Column:
    return F.when(base > 0, (price - base) / base * 100)
