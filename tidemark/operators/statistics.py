"""Statistics on labelled trades: candidates by day, gates, curves and years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import round4
from .labels import micro

trade_order = ["exit_date", "symbol_id", "signal_bar"]


def day_candidates(signals: DataFrame, n: int = 5, by: str = "score") -> DataFrame:
    """Signals ranked within their entry date by score, or by another column, then score; then by symbol; rank beyond n is rejected."""
    rank = F.row_number().over(W.partitionBy("entry_date").orderBy(F.desc(by), F.desc("score"), "symbol_id"))
    return signals.withColumn("rank", rank).withColumn("accepted", F.col("rank") <= n)


def window_gains(curve: DataFrame, days: int = 45) -> DataFrame:
    """(d, gain) of each date: the percent that equity gains until the last date within so many calendar days; windows that go beyond the curve's end are left out."""
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    ahead = W.orderBy("day").rangeBetween(0, days)  # a row a date
    rows = curve.withColumn("day", day).withColumn("end", F.last("equity").over(ahead)).withColumn("last", F.max("day").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return rows.filter(F.col("day") + days <= F.col("last")).select("d", ((F.col("end") / F.col("equity") - 1) * 100).alias("gain"))


def portfolio_stats(trades: DataFrame) -> DataFrame:
    """One row; wins and losses by the sign of R, whatever the label."""
    r = micro("actual_rr")
    gained, lost = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0)), F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0))
    return trades.agg(
        F.count("*").alias("trades"), F.count_if(r > 0).alias("wins"), F.count_if(r < 0).alias("losses"),
        round4(gained / F.nullif(-lost, F.lit(0))).alias("profit_factor"), round4(F.sum(r) / F.lit(1e6) / F.count("*")).alias("avg_r"),
        round4(F.sum("hold_days") / F.count("*")).alias("avg_hold"),
    )


def health(trades: DataFrame, window: int = 20, minimum: float = 0.0, factor: bool = False) -> DataFrame:
    """(exit_date, closed, healthy): after the trades closed by each date, whether the mean R of the last `window` is at least minimum.

    With factor it is their profit factor that counts; without a loss, any gain is healthy.  Open
    until as many have closed.  Trades are ranked within their date; what is sorted as one sequence
    are dates, each with its last trades.
    """
    last_first = W.partitionBy("exit_date").orderBy(F.desc("symbol_id"), F.desc("signal_bar"))
    rows = trades.select(*trade_order, micro("actual_rr").alias("r")).withColumn("k", F.row_number().over(last_first))
    kept = F.when(F.col("k") <= window, F.struct((-F.col("k")).alias("k"), "r"))
    dates = rows.groupBy("exit_date").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["r"]).alias("last"))
    by_date = W.orderBy("exit_date")
    recent = F.flatten(F.collect_list("last").over(by_date.rowsBetween(-window + 1, 0)))  # each date has a trade
    dates = dates.withColumn("closed", F.sum("n").over(by_date)).withColumn("recent", recent)
    dates = dates.withColumn("recent", F.slice("recent", -F.least(F.lit(window), F.size("recent")), window))
    total = lambda test: F.aggregate(F.filter("recent", test), F.lit(0).cast("long"), lambda a, r: a + r)
    gained, lost = total(lambda r: r > 0), total(lambda r: r < 0)
    healthy = F.when(lost < 0, gained / -lost >= minimum).otherwise(gained > 0) if factor else (gained + lost) / F.lit(1e6) / F.lit(float(window)) >= minimum
    return dates.select("exit_date", "closed", ((F.col("closed") < window) | healthy).alias("healthy"))


def gated(signals: DataFrame, gate: DataFrame) -> DataFrame:
    """signals with gate_open: the health after the last exit strictly before the entry date."""
    from .asof import asof

    known = gate.select(F.lit(1).alias("k"), F.date_add("exit_date", 1).alias("entry_date"), "healthy")
    dates = signals.select("entry_date").distinct().withColumn("k", F.lit(1))
    opened = asof(dates, known, ["k"], "entry_date", ["healthy"]).select("entry_date", F.coalesce("healthy", F.lit(True)).alias("gate_open"))
    return signals.join(opened, "entry_date")


def split_stats(trades: DataFrame, by: str) -> DataFrame:
    """(by, trades, avg_r, win_rate)."""
    r = micro("actual_rr")
    return trades.groupBy(by).agg(F.count("*").alias("trades"), round4(F.sum(r) / F.lit(1e6) / F.count("*")).alias("avg_r"), round4(F.count_if(r > 0) / F.count("*") * 100).alias("win_rate"))


def gate_stats(trades: DataFrame, *gates: str) -> DataFrame:
    """(gates, trades, avg_r, win_rate, profit_factor) of each combination of open and closed gates; without a loss the factor is null."""
    r = micro("actual_rr")
    gained, lost = (F.coalesce(F.sum(F.when(test, r)), F.lit(0)) for test in (r > 0, r < 0))
    return trades.groupBy(*gates).agg(
        F.count("*").alias("trades"), round4(F.sum(r) / F.lit(1e6) / F.count("*")).alias("avg_r"), round4(F.count_if(r > 0) / F.count("*") * 100).alias("win_rate"), round4(gained / F.nullif(-lost, F.lit(0))).alias("profit_factor")
    )


def in_regime(trades: DataFrame, regime: DataFrame) -> DataFrame:
    """trades with regime_open of their entry date, from (d, regime_open), a row a date; closed on dates that it lacks."""
    known = regime.select(F.col("d").alias("entry_date"), F.col("regime_open").alias("_open"))
    return trades.join(known, "entry_date", "left").withColumn("regime_open", F.coalesce("_open", F.lit(False))).drop("_open")


def concurrency(trades: DataFrame) -> DataFrame:
    """(d, open): trades open on each date at which that changes; a trade is open on its exit date still."""
    opened = trades.select(F.col("entry_date").alias("d"), F.lit(1).alias("step"))
    closed = trades.select(F.date_add("exit_date", 1).alias("d"), F.lit(-1).alias("step"))
    steps = opened.unionByName(closed).groupBy("d").agg(F.sum("step").alias("step"))
    return steps.select("d", F.sum("step").over(W.orderBy("d")).cast("long").alias("open"))


def equity_curve(trades: DataFrame, candles: DataFrame, start: float = 1_000_000.0, stake: float = 10_000.0) -> DataFrame:
    """(d, open, exits, equity), a row for each date on which a trade is held or ends: cash plus whole shares at the date's close.

    Trades meet their bars in an equi-join on (symbol, bar); sums are of cents, and only dates are sorted.
    """
    shares = F.floor(F.lit(stake) / F.col("entry"))
    cents = lambda price: F.round(shares * (price - F.col("entry")) * 100).cast("long")
    held = trades.select("symbol_id", "entry", F.explode(F.sequence("entry_bar", "exit_bar")).alias("bar"), "exit_bar").filter("bar < exit_bar")
    marked = held.join(candles.select("symbol_id", "bar", "d", "close"), ["symbol_id", "bar"])
    none = F.lit(0).cast("long")
    closed = trades.select(F.col("exit_date").alias("d"), cents(F.col("exit_price")).alias("realised"), none.alias("marked"), F.lit(1).alias("exits"), F.lit(0).alias("open"))
    both = closed.unionByName(marked.select("d", none.alias("realised"), cents(F.col("close")).alias("marked"), F.lit(0).alias("exits"), F.lit(1).alias("open")))
    days = both.groupBy("d").agg(*[F.sum(c).cast("long").alias(c) for c in ("realised", "marked", "exits", "open")])
    running = F.sum("realised").over(W.orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    return days.select("d", "open", "exits", (F.lit(start) + (running + F.col("marked")) / F.lit(100.0)).alias("equity"))


def drawdown(curve: DataFrame, start: float = 1_000_000.0) -> DataFrame:
    """curve with peak (the start at least) and drawdown_pct."""
    peak = F.greatest(F.max("equity").over(W.orderBy("d").rowsBetween(W.unboundedPreceding, 0)), F.lit(start))
    return curve.withColumn("peak", peak).withColumn("drawdown_pct", (F.col("equity") - F.col("peak")) / F.col("peak") * 100)


def cagr(first: Column, last: Column, days: Column) -> Column:
    """Percent a year, over actual days."""
    return (F.pow(last / first, F.lit(365.25) / days) - 1) * 100
