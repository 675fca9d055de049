"""Sentences that tell why a scan chose a bar: an array of strings for each judged row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import pct_from
from .scans import MeanRevOptions, SwingOptions

# The sentences, in their order within a strategy.  Readers of logs match on them.
SWING = (
    "Price above EMA50 (%s) and EMA200 (%s)",
    "Risk/Reward %s exceeds minimum %s",
    "Support zone touched %d %s",
    "Trade quality: %s",
    "Relative strength %s%% vs %s over %d candles",
    "Sector strength %s%%: %s vs %s over %d candles",
    "Volume %sx above rolling average",
)
BREAKOUT = (
    "Price is %s%% below resistance zone %s–%s",
    "Resistance zone touched %d times",
    "Breakout confirmation above %s",
    "Extension: EMA10 %s%%, EMA50 %s%%, 10D %s%%",
    "Volume %sx rolling average",
)
CROSSOVER = (
    "EMA7 (%s) crossed above EMA21 (%s) %s",
    "SL at previous candle low: %s (risk %s)",
    "Nearest resistance target %s — R/R %s",
    "Crossover candle volume %sx rolling average",
)
MEANREV = (
    "RSI%d oversold at %s (< %s) within EMA%d up-trend",
    "Reversion target EMA%d %s (%s%% above entry)",
    "Stop %s = entry − %s×ATR(%s), %s%% risk",
)


def shown(value: Column | float, places: int = 2) -> Column:
    """A number with some decimals, half away from zero, never minus zero; null for null."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    whole = F.round(value * 10**places)
    number = F.when(whole == 0, F.lit(0.0)).otherwise(whole / 10**places)
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", number))


def _listed(*sentences: Column) -> Column:
    return F.array_compact(F.array(*sentences))


def swing_reasons(o: SwingOptions = SwingOptions(), benchmark: str | None = None, lookback: int = 20) -> Column:
    """Of rows of scans.swing; with the name of a benchmark also what scans.with_strength added, where it is known."""
    touches = F.col("support.touches")
    lines = [
        F.format_string(SWING[0], shown(F.col("ema50")), shown(F.col("ema200"))),
        F.format_string(SWING[1], shown(F.col("rr")), shown(o.min_rr)),
        F.format_string(SWING[2], touches, F.when(touches == 1, "time").otherwise("times")),
        F.format_string(SWING[3], F.col("quality")),
    ]
    if benchmark is not None:
        index = F.col("sector").cast("string")
        lines += [
            F.when(F.col("gained").isNotNull(), F.format_string(SWING[4], shown(F.col("gained")), F.lit(benchmark), F.lit(lookback))),
            F.when(F.col("sector_gained").isNotNull(), F.format_string(SWING[5], shown(F.col("sector_gained")), index, F.lit(benchmark), F.lit(lookback))),
        ]
    above = (F.col("avg_volume") > 0) & (F.col("volume_ratio") > 1)
    return _listed(*lines, F.when(above, F.format_string(SWING[6], shown(F.col("volume_ratio"), 1))))


def breakout_reasons() -> Column:
    """Of rows of scans.breakout; an extension whose base isn't known is told as 0."""
    price = F.col("close")
    moved = [shown(F.coalesce(pct_from(price, F.col(base)), F.lit(0.0)), 1) for base in ("ema10", "ema50", "close10")]
    return _listed(
        F.format_string(BREAKOUT[0], shown(F.col("distance_pct")), shown(F.col("resistance.low")), shown(F.col("resistance.high"))),
        F.format_string(BREAKOUT[1], F.col("resistance.touches")),
        F.format_string(BREAKOUT[2], shown(F.col("breakout_price"))),
        F.format_string(BREAKOUT[3], *moved),
        F.when(F.col("avg_volume") > 0, F.format_string(BREAKOUT[4], shown(F.col("volume_ratio")))),
    )


def crossover_reasons() -> Column:
    """Of rows of scans.crossover."""
    age = F.col("cross_age")
    told = F.when(age == 0, "today").when(age == 1, "1 candle ago").otherwise(F.format_string("%d candles ago", age))
    return _listed(
        F.format_string(CROSSOVER[0], shown(F.col("ema7")), shown(F.col("ema21")), told),
        F.format_string(CROSSOVER[1], shown(F.col("sl")), shown(F.col("entry") - F.col("sl"))),
        F.when(F.col("target") > 0, F.format_string(CROSSOVER[2], shown(F.col("target")), shown(F.col("rr")))),
        F.when(F.col("cross_volume_ratio").isNotNull(), F.format_string(CROSSOVER[3], shown(F.col("cross_volume_ratio")))),
    )


def meanrev_reasons(o: MeanRevOptions = MeanRevOptions()) -> Column:
    """Of rows of scans.meanrev."""
    entry, sl = F.col("entry"), F.col("sl")
    return _listed(
        F.format_string(MEANREV[0], F.lit(2), shown(F.col("rsi2"), 1), shown(o.max_rsi, 0), F.lit(200)),
        F.format_string(MEANREV[1], F.lit(10), shown(F.col("target")), shown(pct_from(F.col("target"), entry), 1)),
        F.format_string(MEANREV[2], shown(sl), shown(o.stop_atr, 1), shown(F.col("atr14")), shown((entry - sl) / entry * 100, 1)),
    )
