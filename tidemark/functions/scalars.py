"""Scalar functions on prices, ratios, names and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def round2(v: Column) -> Column:
    """To cents, half away from zero."""
    return F.round(v * 100) / 100


def round4(v: Column) -> Column:
    return F.round(v * 10000) / 10000


def pct_from(price: Column, base: Column) -> Column:
    """Percent of price above base; 0 without a positive base."""
    return F.when(base > 0, (price - base) / base * 100).otherwise(F.lit(0.0))


def norm_symbol(s: Column) -> Column:
    """EXCH:SYM.SFX to SYM."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^[^:]*:", ""), r"\..*$", "")))


def index_symbol(name: Column) -> Column:
    return F.upper(F.regexp_replace(name, r"\s+", ""))


def trend_class(price: Column, fast: Column, slow: Column) -> Column:
    """bullish above both averages, bearish below both, else neutral; an average that isn't seeded never counts."""
    return F.when((price > fast) & (price > slow), "bullish").when((price < fast) & (price < slow), "bearish").otherwise("neutral")


def close_strength(high: Column, low: Column, close: Column) -> Column:
    """Where in the bar's range it closed; null without a range."""
    return F.when(high > low, (close - low) / (high - low))


def rr_grade(rr: Column) -> Column:
    return F.when(rr >= 3, "excellent").when(rr >= 2, "good").when(rr >= 1.5, "fair").otherwise("poor")


def buy_fill(price: Column, slip: float) -> Column:
    return price * F.lit(1 + slip)


def sell_fill(price: Column, slip: float) -> Column:
    return price * F.lit(1 - slip)


def net_pct(entry: Column, exit_: Column, slip: float = 0.002, round_trip: float = 0.0025) -> Column:
    """Percent gained after slippage and half of the round-trip cost on each leg."""
    leg = round_trip / 2
    return (exit_ * F.lit(1 - slip) * F.lit(1 - leg) / (entry * F.lit(1 + slip) * F.lit(1 + leg)) - 1) * 100


def position_notional(equity: Column, cash: Column, entry: Column, stop: Column, risk_pct: float, max_weight_pct: float, max_positions: int) -> Column:
    """Cash for a position: what a stop-out of risk_pct allows, capped by weight and cash; equal slices without risk_pct."""
    if risk_pct > 0:
        risk = (entry - stop) / entry
        sized = F.least(equity * F.lit(risk_pct / 100) / F.when(risk > 0, risk), equity * F.lit(max_weight_pct / 100))
        return F.when(risk > 0, F.least(sized, cash)).otherwise(F.lit(0.0))
    return F.least(equity / F.lit(float(max_positions)), cash)


# Days without a session besides Saturdays and Sundays.
HOLIDAYS = (
    "2026-01-26", "2026-02-26", "2026-03-04", "2026-04-03", "2026-04-14", "2026-05-01", "2026-10-02", "2026-10-20", "2026-11-09", "2026-11-10", "2026-11-25", "2026-12-25",
)


def market_open(ts: Column, zone: str = "Asia/Kolkata", holidays: tuple[str, ...] = HOLIDAYS) -> Column:
    """Monday to Friday from 09:15 to 15:30, both included, by the clock of the zone; never on holidays there."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local) + F.second(local) / F.lit(60.0)
    return (F.weekday(local) < 5) & ~F.date_format(local, "yyyy-MM-dd").isin(*holidays) & (minute >= 9 * 60 + 15) & (minute <= 15 * 60 + 30)


def session_fraction(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """Elapsed share of the 375 minutes of a session, 30 of them at least; 1 outside."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local) + F.second(local) / F.lit(60.0) - (9 * 60 + 15)
    return F.when(market_open(ts, zone), F.greatest(minute, F.lit(30.0)) / 375).otherwise(F.lit(1.0))


def period_start(period: str, end: Column) -> Column:
    """2y, 6m or 90d before end; months clamp to their last day."""
    n, unit = int(period[:-1]), period[-1]
    return F.date_sub(end, n) if unit == "d" else F.add_months(end, -n * (12 if unit == "y" else 1))
