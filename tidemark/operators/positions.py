"""A daily batch on open positions, and what a purse buys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import buy_fill, let, pct_from, position_notional, round2, sell_fill

STAKE = 10_000.0


def open_positions(trades: DataFrame, asof: str, stake: float = STAKE) -> DataFrame:
    """(symbol_id, entry_date, entry, sl, target, atr, shares) of trades entered before a date and not yet ended: the last for each symbol."""
    day = F.lit(asof).cast("date")
    held = trades.filter((F.col("entry_date") < day) & (F.col("exit_date") >= day)).withColumn("shares", F.floor(F.lit(stake) / F.col("entry")))
    last = held.groupBy("symbol_id").agg(F.max(F.struct("entry_date", "entry", "sl", "target", "atr", "shares")).alias("p"))
    return last.select("symbol_id", "p.*")


def exits(positions: DataFrame, rows: DataFrame, asof: str) -> DataFrame:
    """positions with outcome of the day (loss at the stop, recross at the close, else hold), exit, R and profit."""
    today = rows.filter(F.col("d") == F.lit(asof).cast("date")).select("symbol_id", "low", "close", "ema7", "ema21")
    judged = positions.join(today, "symbol_id", "left").withColumn("outcome", F.when(F.col("low") <= F.col("sl"), "loss").when(F.col("ema7") < F.col("ema21"), "recross").otherwise("hold"))
    price = F.when(F.col("outcome") == "loss", F.col("sl")).when(F.col("outcome") == "recross", F.col("close"))
    return judged.withColumn("exit", price).withColumn("r", (F.col("exit") - F.col("entry")) / (F.col("entry") - F.col("sl"))).withColumn("pnl", round2(F.col("shares") * (F.col("exit") - F.col("entry")))).drop("low", "close", "ema7", "ema21")


def mark(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """positions with price (entry, if none is known), unrealised profit and whether the stop is breached."""
    rows = positions.join(prices, "symbol_id", "left").withColumn("price", F.coalesce("price", "entry"))
    return rows.withColumn("pnl", round2(F.col("shares") * (F.col("price") - F.col("entry")))).withColumn("pnl_pct", pct_from(F.col("price"), F.col("entry"))).withColumn("breached", F.col("price") <= F.col("sl"))


def queue(candidates: DataFrame, held: DataFrame, slots: int, gate_open: bool = True, min_score: float = 0.0) -> DataFrame:
    """Candidates that aren't held, best first, for the free slots; into the shadow queue if the gate is closed."""
    free = candidates.filter(F.col("score") >= min_score).join(held.select("symbol_id").distinct(), "symbol_id", "left_anti")
    rank = F.row_number().over(W.orderBy(F.desc("score"), "symbol_id"))
    ranked = free.orderBy(F.desc("score"), "symbol_id").limit(slots)
    return ranked.withColumn("rank", rank).withColumn("shadow", F.lit(not gate_open))


@dataclass(frozen=True)
class FillOptions:
    slots: int = 5
    risk_pct: float = 1.0
    max_weight_pct: float = 40.0
    slip: float = 0.002
    #: Cost of a leg: a share of what is bought or sold.
    leg_cost: float = 0.00125


def fill(pending: DataFrame, purse: DataFrame, o: FillOptions = FillOptions()) -> DataFrame:
    """(entry_date, symbol_id, entry, shares, cost, stopped, exit, pnl, r, cash): what a date's queue buys at its open, with what was left.

    pending has entry_date, symbol_id, score, sl and the open and low of the date (a symbol without a
    bar that day isn't in it); purse has entry_date, cash and equity, a row a date.  Each date is on
    its own: the slots best by score, then symbol, are what its queue holds; in symbol order each
    gets the whole shares that its risk, its weight and the cash left allow, costs included, so that
    a dear one leaves the rest to the next.  One without a share is dropped.  A low at the stop or
    below sells at once, and the proceeds go back to the cash.  Dates without a purse buy nothing.
    """
    rank = F.row_number().over(W.partitionBy("entry_date").orderBy(F.desc("score"), "symbol_id"))
    queued = pending.withColumn("_rank", rank).filter(F.col("_rank") <= o.slots)
    orders = F.array_sort(F.collect_list(F.struct("symbol_id", "open", "low", "sl")))  # slots of them at most
    dates = queued.groupBy("entry_date").agg(orders.alias("orders")).join(purse.select("entry_date", "cash", "equity"), "entry_date")
    fills = "array<struct<symbol_id:bigint,entry:double,shares:bigint,cost:double,stopped:boolean,exit:double,pnl:double,r:double,cash:double>>"

    def step(a: Column, p: Column) -> Column:
        def bought(entry: Column) -> Column:
            each = entry * F.lit(1 + o.leg_cost)
            notional = position_notional(F.col("equity"), a["cash"], entry, p["sl"], o.risk_pct, o.max_weight_pct, o.slots)
            return let(F.floor(notional / each), lambda shares: let(shares * each, lambda cost: after(entry, shares, cost)))

        def after(entry: Column, shares: Column, cost: Column) -> Column:
            stopped = p["low"] <= p["sl"]
            sold = F.when(stopped, sell_fill(p["sl"], o.slip))
            proceeds = shares * sold * F.lit(1 - o.leg_cost)
            left = a["cash"] - cost + F.coalesce(proceeds, F.lit(0.0))
            one = F.struct(
                p["symbol_id"].cast("long").alias("symbol_id"), entry.alias("entry"), shares.alias("shares"), cost.alias("cost"), stopped.alias("stopped"), sold.alias("exit"),
                (proceeds - cost).alias("pnl"), ((sold - entry) / (entry - p["sl"])).alias("r"), left.alias("cash"),
            )
            return F.when(shares > 0, F.struct(left.alias("cash"), F.concat(a["fills"], F.array(one)).alias("fills"))).otherwise(a)

        return let(buy_fill(p["open"], o.slip), bought)

    start = F.struct(F.col("cash").cast("double").alias("cash"), F.array().cast(fills).alias("fills"))
    return dates.select("entry_date", F.explode(F.aggregate("orders", start, step)["fills"]).alias("f")).select("entry_date", "f.*")


def capital_journey(trades: DataFrame, start: float = 100_000.0) -> DataFrame:
    """(symbol_id, trades, skipped, final): a symbol's trades in order of entry, each with as many whole shares as its capital buys.

    The capital passes from trade to trade: an ordered fold over the trades of one symbol.
    """
    rows = trades.groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("entry_date", "entry", "exit_price"))).alias("all"))

    def step(a, t):
        shares = F.floor(a["capital"] / t["entry"])
        taken = shares > 0
        return F.struct((a["capital"] + shares * (t["exit_price"] - t["entry"])).alias("capital"), (a["n"] + taken.cast("long")).alias("n"), (a["skipped"] + (~taken).cast("long")).alias("skipped"))

    end = F.aggregate("all", F.struct(F.lit(start).alias("capital"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("skipped")), step)
    return rows.select("symbol_id", end.alias("x")).select("symbol_id", F.col("x.n").alias("trades"), F.col("x.skipped").alias("skipped"), F.col("x.capital").alias("final"))


def shadow_trades(positions: DataFrame, rows: DataFrame, asof: str, slip: float = 0.002) -> DataFrame:
    """(symbol_id, outcome, r) of shadow positions that end on a date: R after slippage, no capital; it feeds the health gate."""
    ended = exits(positions, rows, asof).filter("outcome <> 'hold'")
    bought, sold = F.col("entry") * F.lit(1 + slip), F.col("exit") * F.lit(1 - slip)
    return ended.select("symbol_id", "outcome", ((sold - bought) / (bought - F.col("sl"))).alias("r"))
