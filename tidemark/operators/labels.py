"""Outcomes of signals on the bars after them, all at once, and what they sum up to."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import buy_fill, net_pct, round4, sell_fill
from .groups import per_symbol, per_symbol_of_both

EXIT = "string, exit_bar int, exit_date date, exit_price double"


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Least values of the stretches of 1, 2, 4, ... from each place on."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
        width *= 2
    return levels


def first_at_most(levels: list[np.ndarray], start: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The first place from start to end whose value is at most limit, of each; places beyond all where there is none.

    The stretches that are above the limit are left behind, the longest first: as many steps as
    levels, however far the place is.
    """
    at = start.copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(at + (1 << k) - 1 <= end)
        above = fits[levels[k][at[fits]] > limit[fits]]
        at[above] += 1 << k
    return np.where((at <= end) & (start <= end), at, len(levels[0]))


class Bars:
    """The bars of one symbol, in order."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.bar = self._numbers("bar", 0).astype(np.int64)
        self.close = self._numbers("close", np.nan)
        self.low, self.high = self._numbers("low", np.inf), self._numbers("high", -np.inf)

    def _numbers(self, name: str, missing: float) -> np.ndarray:
        return pc.fill_null(self.rows.column(name), missing).to_numpy().astype(float)

    def held(self, signals: pa.Table, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first and last bar from each signal's entry to `last`; the first is beyond the last where there is none."""
        entry = signals.column("entry_bar").to_numpy()
        return np.searchsorted(self.bar, entry), np.searchsorted(self.bar, np.maximum(last, entry), "right") - 1


def _of(signals: pa.Table, name: str, missing: float) -> np.ndarray:
    return pc.fill_null(signals.column(name).cast(pa.float64()), missing).to_numpy()


def _exits(signals: DataFrame, candles: DataFrame, columns: tuple[str, ...], kind: str, resolve: Callable[[pa.Table, Bars], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """signals with kind and the exit, by symbol; resolve gives (which signals, kind, place of the exit, price).

    One shuffle of signals and bars by symbol; no row is made for a bar that is held.
    """

    def label(some: pa.Table, rows: pa.Table) -> pa.Table:
        bars = Bars(rows)
        which, kinds, at, price = resolve(some, bars) if some.num_rows and rows.num_rows else (np.zeros(0, np.int64), np.zeros(0, str), np.zeros(0, np.int64), np.zeros(0))
        out = some.take(pa.array(which))
        for name, values in ((kind, pa.array(kinds.tolist(), pa.string())), ("exit_bar", pa.array(bars.bar[at], pa.int32())), ("exit_date", bars.rows.column("d").take(pa.array(at))), ("exit_price", pa.array(price, pa.float64()))):
            out = out.append_column(name, values)
        return out

    schema = T.StructType([*signals.schema.fields, *T._parse_datatype_string(f"{kind} {EXIT}").fields])
    rows = candles.select("symbol_id", F.col("bar").cast("int").alias("bar"), "d", *columns)
    return per_symbol_of_both(signals, rows, label, schema)


def _rated(ended: DataFrame) -> DataFrame:
    return ended.withColumn("actual_rr", (F.col("exit_price") - F.col("entry")) / (F.col("entry") - F.col("sl"))).withColumn("hold_days", F.col("exit_bar") - F.col("entry_bar") + 1)


def barrier(signals: DataFrame, candles: DataFrame, max_hold: int | None = 20) -> DataFrame:
    """First of stop, target and max_hold bars (counted from 1; None: the last bar); outcome loss, win or timeout; the stop wins ties."""

    def resolve(some: pa.Table, bars: Bars):
        start, end = bars.held(some, some.column("entry_bar").to_numpy() + max_hold - 1 if max_hold else np.full(some.num_rows, bars.bar[-1]))
        sl, target = _of(some, "sl", -np.inf), _of(some, "target", 0)
        stop = first_at_most(minima(bars.low), start, end, sl)
        win = first_at_most(minima(-bars.high), start, end, np.where(target > 0, -target, -np.inf))
        stopped, won = (stop <= win) & (stop <= end), win <= end
        at = np.where(stopped, stop, np.where(won, win, end))
        which = np.flatnonzero(start <= end)
        kinds = np.where(stopped, "loss", np.where(won, "win", "timeout"))
        return which, kinds[which], at[which], np.where(stopped, sl, np.where(won, target, bars.close[at]))[which]

    return _rated(_exits(signals, candles, ("low", "high", "close"), "outcome", resolve))


def trailing(signals: DataFrame, candles: DataFrame, atr_multiplier: float = 1.5, max_hold: int | None = 20) -> DataFrame:
    """As barrier, with a stop that follows the highest high of earlier bars at a distance, once that is above the entry.

    The stop changes at each bar: a step a bar for all signals of a symbol that are still open.
    """

    def resolve(some: pa.Table, bars: Bars):
        start, end = bars.held(some, some.column("entry_bar").to_numpy() + max_hold - 1 if max_hold else np.full(some.num_rows, bars.bar[-1]))
        sl, target, entry, atr = _of(some, "sl", -np.inf), _of(some, "target", 0), _of(some, "entry", np.nan), _of(some, "atr", 0)
        which = np.flatnonzero(start <= end)
        kinds, at, price = np.full(len(start), "timeout", object), end.copy(), bars.close[np.maximum(end, 0)]
        peak, open_, place = entry.copy(), which, start.copy()
        while len(open_):
            i = place[open_]
            follows = (peak[open_] > entry[open_]) & (atr[open_] > 0)
            stop = np.maximum(sl[open_], np.where(follows, peak[open_] - atr_multiplier * atr[open_], -np.inf))
            stopped = bars.low[i] <= stop
            won = ~stopped & (target[open_] > 0) & (bars.high[i] >= target[open_])
            for hit, kind, exit_price in ((stopped, np.where(stop > sl[open_], "trail_stop", "loss"), stop), (won, np.full(len(i), "win", object), target[open_])):
                kinds[open_[hit]], at[open_[hit]], price[open_[hit]] = kind[hit], i[hit], exit_price[hit]
            peak[open_] = np.fmax(peak[open_], bars.high[i])
            place[open_] += 1
            open_ = open_[~stopped & ~won & (place[open_] <= end[open_])]
        return which, kinds[which], at[which], price[which]

    return _rated(_exits(signals, candles, ("low", "high", "close"), "outcome", resolve))


def ema_exit(signals: DataFrame, rows: DataFrame, slip: float = 0.002, max_hold: int | None = None, target_exit: bool = False) -> DataFrame:
    """Stop first, from the entry bar on; else the close where ema7 falls below ema21 after it; else timeout or the last close.

    With target_exit the target, from the bar after the entry on, takes the place of the averages.
    status stop, recross or target, timeout or open; hold counted from 0; rr after slippage on both
    legs.  Signals whose entry bar rows lacks are left out.
    """

    def resolve(some: pa.Table, bars: Bars):
        entry_bar, n = some.column("entry_bar").to_numpy(), len(bars.bar)
        start, end = bars.held(some, entry_bar + max_hold if max_hold else np.full(some.num_rows, bars.bar[-1]))
        sl, target = _of(some, "sl", -np.inf), _of(some, "target", 0)
        which = np.flatnonzero((start < n) & (bars.bar[np.minimum(start, n - 1)] == entry_bar))
        if target_exit:
            ends = first_at_most(minima(-bars.high), start + 1, end, np.where(target > 0, -target, -np.inf))
        else:
            fast, slow = (bars._numbers(c, np.nan) for c in ("ema7", "ema21"))
            falls = np.where(fast < slow, np.arange(n), n)
            later = np.append(np.minimum.accumulate(falls[::-1])[::-1], n)  # the first at or after a place
            ends = later[np.minimum(start + 1, n)]
        done = ends <= end
        bound = np.where(done, ends, end)
        stop = first_at_most(minima(bars.low), start, bound, sl)
        stopped = stop <= bound
        timed = np.full(len(start), False) if not max_hold else bars.bar[np.maximum(bound, 0)] - entry_bar >= max_hold
        kinds = np.where(stopped, "stop", np.where(done, "target" if target_exit else "recross", np.where(timed, "timeout", "open")))
        at = np.where(stopped, stop, bound)
        price = np.where(stopped, sl, np.where(done & target_exit, target, bars.close[np.minimum(at, n - 1)]))
        return which, kinds[which], at[which], price[which]

    needed = ("low", "high", "close") + (() if target_exit else ("ema7", "ema21"))
    out = _exits(signals, rows, needed, "status", resolve)
    bought = buy_fill(F.col("entry"), slip)
    rr = F.when(bought - F.col("sl") > 0, (sell_fill(F.col("exit_price"), slip) - bought) / (bought - F.col("sl"))).otherwise(F.lit(0.0))
    return out.withColumn("actual_rr", rr).withColumn("hold_days", F.col("exit_bar") - F.col("entry_bar")).withColumn("net_pct", net_pct(F.col("entry"), F.col("exit_price")))


def non_overlapping(trades: DataFrame) -> DataFrame:
    """Trades of a symbol, in order, without those that begin before the last kept one has ended."""

    def kept(rows: pa.Table) -> pa.Table:
        rows, until, chosen = rows.sort_by("signal_bar"), -1, []
        for k, (begin, end) in enumerate(zip(rows.column("signal_bar").to_pylist(), rows.column("exit_bar").to_pylist())):
            if begin > until:
                chosen.append(k)
                until = end
        return rows.take(chosen)

    return per_symbol(trades, kept, trades.schema)


def micro(r: Column | str) -> Column:
    """In millionths, an integer: sums don't depend on their order."""
    return F.round((F.col(r) if isinstance(r, str) else r) * 1000000).cast("long")


def loss_streak(trades: DataFrame) -> Column:
    """Steps for a streak: +1 for a loss, 0 for a reset, null for a timeout, which does neither."""
    rr = F.col("actual_rr")
    return F.when(F.col("outcome") == "loss", 1).when(F.col("outcome") == "timeout", None).when((F.col("outcome") == "trail_stop") & (rr < 0), 1).otherwise(0)


def max_loss_streak(trades: DataFrame) -> DataFrame:
    """(max_loss_streak) of all trades in order of (exit_date, symbol_id, signal_bar).

    Runs between resets are counted within each date; only a date's first and last run go on in its
    neighbours, so that one sort is of dates, a row each.
    """
    order = W.partitionBy("exit_date").orderBy("symbol_id", "signal_bar")
    steps = trades.withColumn("step", loss_streak(trades)).filter("step is not null").withColumn("island", F.sum(1 - F.col("step")).over(order))
    runs = steps.groupBy("exit_date", "island").agg(F.sum("step").alias("run"))
    dates = runs.groupBy("exit_date").agg(F.max("island").alias("resets"), F.max(F.when(F.col("island") == 0, F.col("run"))).alias("first"), F.max_by("run", "island").alias("last"), F.max("run").alias("longest"))
    dates = dates.withColumn("stretch", F.sum((F.col("resets") > 0).cast("int")).over(W.orderBy("exit_date")))
    ends = F.when(F.col("resets") > 0, F.array(F.struct((F.col("stretch") - 1).alias("stretch"), F.coalesce("first", F.lit(0)).alias("run")), F.struct("stretch", F.col("last").alias("run")))).otherwise(F.array(F.struct("stretch", F.col("last").alias("run"))))
    joined = dates.select(F.explode(ends).alias("x")).groupBy("x.stretch").agg(F.sum("x.run").alias("run"))
    longest = joined.select("run").unionByName(dates.select(F.col("longest").alias("run")))
    return longest.agg(F.coalesce(F.max("run"), F.lit(0)).alias("max_loss_streak"))


def summary(trades: DataFrame) -> DataFrame:
    """One row of counts, rates and averages; timeouts and trails are outside the win rate."""
    of = lambda kind: F.count_if(F.col("outcome") == kind)
    mean = lambda kind: F.coalesce(F.sum(F.when(F.col("outcome") == kind, micro("actual_rr"))) / F.lit(1e6) / F.nullif(of(kind), F.lit(0)), F.lit(0.0))
    gained, lost = (F.coalesce(F.sum(F.when(test, micro("actual_rr"))), F.lit(0)) for test in (F.col("actual_rr") > 0, F.col("actual_rr") < 0))
    return trades.agg(
        F.count("*").alias("trades"), of("win").alias("wins"), of("loss").alias("losses"), of("timeout").alias("timeouts"), of("trail_stop").alias("trail_stops"),
        round4(F.coalesce(of("win") / F.nullif(of("win") + of("loss"), F.lit(0)) * 100, F.lit(0.0))).alias("win_rate"),
        round4(mean("win")).alias("avg_win_rr"), round4(mean("loss")).alias("avg_loss_rr"), round4(mean("trail_stop")).alias("avg_trail_rr"),
        round4(gained / F.nullif(-lost, F.lit(0))).alias("profit_factor"), round4(F.sum(micro("actual_rr")) / F.lit(1e6) / F.count("*")).alias("expectancy"),
        round4(F.sum("hold_days") / F.count("*")).alias("avg_hold_days"),
    )
