"""Recursive indicators, a symbol at a time, and windowed ones on their result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from .groups import dealt

EMAS = (7, 10, 20, 21, 50, 200)
ATR_PERIOD = 14
RSIS = (2, 14)
CANDLE = ("d", "bar", "open", "high", "low", "close", "volume")


def by_bar() -> WindowSpec:
    return W.partitionBy("symbol_id").orderBy("bar")


def ema(values: list[float], period: int) -> list[float | None]:
    """Exponential average, begun with the mean of the first `period` values."""
    k, total, last, out = 2.0 / (period + 1), 0.0, None, []
    for n, v in enumerate(values, 1):
        if n <= period:
            total += v
            last = total / period if n == period else None
        else:
            last = v * k + last * (1 - k)
        out.append(last)
    return out


def wilder(values: list[float], period: int) -> list[float | None]:
    """Mean of the first `period` values, then smoothed; None until then."""
    total, last, out = 0.0, None, []
    for n, v in enumerate(values, 1):
        if n <= period:
            total += v
            last = total / period if n == period else None
        else:
            last = (last * (period - 1) + v) / period
        out.append(last)
    return out


def cents(v: np.ndarray) -> np.ndarray:
    """Half away from zero, as all prices here are positive."""
    return np.floor(v * 100 + 0.5) / 100


VALUES = tuple(f"ema{p}" for p in EMAS) + ("true_range", "atr14") + tuple(f"rsi{p}" for p in RSIS)


class Matrix:
    """The bars of some symbols as columns, the longest first, so that at each bar the symbols that have one are the first."""

    def __init__(self, symbol: np.ndarray):
        """symbol of each row; rows are in order of symbol, then bar."""
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(symbol) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(symbol)))
        order = np.argsort(-sizes, kind="stable")
        column = np.empty(len(first), np.int64)
        column[order] = np.arange(len(first))
        self.at = np.arange(len(symbol)) - np.repeat(first, sizes), np.repeat(column, sizes)
        self.shape = int(sizes.max(initial=0)), len(first)
        #: The column of each symbol.
        self.column = column
        #: Symbols that have a bar, by bar.
        self.alive = np.searchsorted(np.sort(-sizes), -np.arange(self.shape[0]), "left")

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.full(self.shape, np.nan)
        out[self.at] = values
        return out

    def rows(self, matrix: np.ndarray) -> np.ndarray:
        return matrix[self.at]

    def smoothed(self, values: np.ndarray, period: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray], skip: int = 0) -> np.ndarray:
        """The mean of the first `period` values from bar `skip` on, then step(value, last) bar by bar; NaN until then."""
        out, total = np.full(self.shape, np.nan), np.zeros(self.shape[1])
        for t in range(skip, self.shape[0]):
            n = self.alive[t]
            if t - skip < period:
                total[:n] += values[t, :n]
                if t - skip == period - 1:
                    out[t, :n] = total[:n] / period
            else:
                out[t, :n] = step(values[t, :n], out[t - 1, :n])
        return out

    def final(self, values: np.ndarray, period: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, skip: int = 0) -> np.ndarray:
        """What smoothed comes to at the last bar of each symbol; the sum of its values where they are fewer than `period`."""
        last = np.zeros(self.shape[1])
        for t in range(skip, self.shape[0]):
            n = self.alive[t]
            if t - skip < period:
                last[:n] += values[t, :n]
                if t - skip == period - 1:
                    last[:n] /= period
            else:
                last[:n] = step(values[t, :n], last[:n])
        return last[self.column]


def ema_step(period: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    k = 2.0 / (period + 1)
    return lambda v, last: v * k + last * (1 - k)


def wilder_step(period: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda v, last: (last * (period - 1) + v) / period


def recursive(bars: pa.Table, values: tuple[str, ...] = VALUES) -> pa.Table:
    """The bars of some symbols with those of their recursive values that are asked for: a step a bar for all symbols at once."""
    bars = bars.sort_by([("symbol_id", "ascending"), ("bar", "ascending")])
    matrix = Matrix(bars.column("symbol_id").to_numpy())
    high, low, close = (matrix.of(pc.fill_null(bars.column(c), np.nan).to_numpy()) for c in ("high", "low", "close"))
    before = np.vstack([np.full((1, matrix.shape[1]), np.nan), close[:-1]]) if len(close) else close
    columns = {}
    for p in (p for p in EMAS if f"ema{p}" in values):
        columns[f"ema{p}"] = matrix.smoothed(close, p, ema_step(p))
    spans = np.maximum(np.maximum(high - low, np.abs(high - before)), np.abs(before - low))
    columns["true_range"] = spans
    if "atr14" in values:
        columns["atr14"] = cents(matrix.smoothed(spans, ATR_PERIOD, wilder_step(ATR_PERIOD), 1))
    change = close - before
    for p in (p for p in RSIS if f"rsi{p}" in values):
        gain, loss = (matrix.smoothed(np.maximum(c, 0.0), p, wilder_step(p), 1) for c in (change, -change))
        with np.errstate(divide="ignore", invalid="ignore"):
            strength = 100 - 100 / (1 + gain / loss)
        columns[f"rsi{p}"] = np.where(np.isnan(loss), np.nan, np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), strength))
    for name in values:
        bars = bars.append_column(name, pa.array(matrix.rows(columns[name]), from_pandas=True))
    return bars


def indicators(candles: DataFrame, *values: str) -> DataFrame:
    """candles with values, which may be ema7 .. ema200, true_range, atr14 (to cents), rsi2 and rsi14, or all; null until seeded.

    One shuffle, by the group that a symbol is dealt to; a bar's values need it and the bars before
    it only.  The recursion has no form as a window; here a step computes a bar of all symbols of a
    group, whose bars a task holds as a matrix.
    """
    rows = candles.select("symbol_id", *CANDLE)
    asked = values or VALUES
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", " + ", ".join(f"{v} double" for v in asked)
    return dealt(rows).groupBy("_group").applyInArrow(lambda bars: recursive(bars.drop_columns("_group"), asked), schema)


def volume_stats(rows: DataFrame, window: int = 20) -> DataFrame:
    """With avg_volume of the bars before, at most window, and volume_ratio to it."""
    average = F.coalesce(F.avg("volume").over(by_bar().rowsBetween(-window, -1)), F.lit(0.0))
    return rows.withColumn("avg_volume", average).withColumn("volume_ratio", F.when(F.col("avg_volume") > 0, F.col("volume") / F.col("avg_volume")).otherwise(F.lit(0.0)))


def crossings(rows: DataFrame, max_age: int = 2) -> DataFrame:
    """With cross (ema7 rises above ema21 at this bar) and cross_age of the last one, if it holds and isn't older than max_age."""
    e7, e21 = F.lag("ema7").over(by_bar()), F.lag("ema21").over(by_bar())
    cross = F.coalesce((F.col("bar") >= 22) & (F.col("ema7") > F.col("ema21")) & (e7 <= e21), F.lit(False))
    rows = rows.withColumn("cross", cross)
    last = F.last(F.when(F.col("cross"), F.col("bar")), ignorenulls=True).over(by_bar().rowsBetween(-max_age, 0))
    return rows.withColumn("cross_bar", F.when(F.col("ema7") > F.col("ema21"), last)).withColumn("cross_age", F.col("bar") - F.col("cross_bar"))


def extrema(rows: DataFrame, window: int = 2) -> DataFrame:
    """With is_low and is_high: strictly beyond all bars within window on both sides, known window bars later."""
    before, after = by_bar().rowsBetween(-window, -1), by_bar().rowsBetween(1, window)
    inside = (F.count("*").over(before) == window) & (F.count("*").over(after) == window)
    low = inside & (F.min("low").over(before) > F.col("low")) & (F.min("low").over(after) > F.col("low"))
    high = inside & (F.max("high").over(before) < F.col("high")) & (F.max("high").over(after) < F.col("high"))
    return rows.withColumn("is_low", low).withColumn("is_high", high).withColumn("confirm_bar", F.col("bar") + window)


def latest(rows: DataFrame) -> DataFrame:
    """The last bar of each symbol."""
    return rows.withColumn("_last", F.max("bar").over(W.partitionBy("symbol_id"))).filter("bar = _last").drop("_last")
