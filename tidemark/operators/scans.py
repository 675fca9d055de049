"""Signal scans: filters in a fixed order, of which the first that fails is the reason, on every bar at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import close_strength, pct_from, round2, rr_grade, trend_class
from ..sources.shared import written
from .asof import asof, with_return
from .indicators import CANDLE, VALUES, by_bar, crossings, extrema, indicators, latest, volume_stats
from .state import initial_state, live_features
from .zones import extremes_of, with_nearest


@dataclass(frozen=True)
class SwingOptions:
    min_candles: int = 200
    ema_margin_pct: float | None = 1.0
    slope_period: int = 20
    allow_bearish_candle: bool = False
    atr_multiplier: float = 1.5
    stop_buffer_pct: float = 0.005
    min_resistance_touches: int = 2
    min_rr: float = 2.0
    max_risk_pct: float | None = 8.0
    min_risk_pct: float | None = 1.5
    max_ema10_pct: float | None = 8.0
    max_ema50_pct: float | None = 15.0
    max_support_pct: float | None = 5.0
    max_move10_pct: float | None = 12.0
    min_avg_volume: int = 0
    max_breakout_pct: float = 3.0
    #: Percent on the benchmark that a symbol gained at least, and its sector; None: not asked.
    min_strength: float | None = None
    min_sector_strength: float | None = None
    #: Whether a mapped sector without data is a reject.
    sector_strict: bool = False


#: Checks on risk, extension and candle off, for data where the strict set rarely fires.
LENIENT = SwingOptions(ema_margin_pct=None, slope_period=0, allow_bearish_candle=True, min_rr=1.0, max_risk_pct=None, min_risk_pct=None, max_ema10_pct=None, max_ema50_pct=None, max_support_pct=None, max_move10_pct=None)


@dataclass(frozen=True)
class CrossOptions:
    min_candles: int = 50
    max_age: int = 2
    min_rr: float = 1.5
    min_target_pct: float = 4.0
    min_risk_pct: float = 3.0
    min_close_strength: float = 0.0
    min_surge: float = 0.0
    surge_window: int = 10


@dataclass(frozen=True)
class MeanRevOptions:
    min_candles: int = 210
    max_rsi: float = 10.0
    stop_atr: float = 2.5


#: What each strategy reads of bar_features beside the candle.
NEEDED = {
    "swing": ("trend", "ema10", "ema50", "ema200", "ema200_past", "close10", "atr14", "avg_volume", "volume_ratio"),
    "breakout": ("trend", "ema10", "ema50", "ema200", "close10", "avg_volume", "volume_ratio"),
    "crossover": ("ema7", "ema21", "cross_age", "crossed", "surge_volume", "atr14"),
    "meanrev": ("ema10", "ema200", "rsi2", "atr14"),
}
#: What entries at the next bar read.
ENTRY = ("next_open", "next_close", "next_d")
#: Recursive values that derived columns are made of.
MADE_OF = {"trend": ("ema50", "ema200"), "ema200_past": ("ema200",), "cross_age": ("ema7", "ema21"), "crossed": ("ema7", "ema21"), "cross": ("ema7", "ema21")}


def bar_features(candles: DataFrame, max_age: int = 2, strategy: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Every column that the scans need but zones, or what one of them needs and more, each known at its bar: one shuffle by symbol serves them all."""
    needed = (*NEEDED[strategy], *more) if strategy else ()
    asked = [v for v in VALUES if v in {x for c in needed for x in MADE_OF.get(c, (c,))}] or list(VALUES)
    known = indicators(candles, *asked).withColumns({v: F.lit(None).cast("double") for v in VALUES if v not in asked})
    rows = derived(known, max_age)
    return rows.select("symbol_id", *CANDLE, *needed, *ENTRY) if strategy else rows


def derived(known: DataFrame, max_age: int) -> DataFrame:
    rows = crossings(volume_stats(known), max_age)
    crossed = F.last(F.when(F.col("cross"), F.struct(F.col("prior_low").alias("prior_low"), "volume", "avg_volume")), ignorenulls=True).over(by_bar().rowsBetween(-max_age, 0))
    return (
        rows.withColumn("prior_low", F.lag("low").over(by_bar()))
        .withColumn("crossed", crossed)
        .withColumn("trend", trend_class(F.col("close"), F.col("ema50"), F.col("ema200")))
        .withColumn("ema200_past", F.lag("ema200", 20).over(by_bar()))
        .withColumn("close10", F.lag("close", 10).over(by_bar()))
        .withColumn("close20", F.lag("close", 20).over(by_bar()))
        .withColumn("surge_volume", F.avg("volume").over(by_bar().rowsBetween(-10, -1)))
        .withColumn("next_open", F.lead("open").over(by_bar()))
        .withColumn("next_close", F.lead("close").over(by_bar()))
        .withColumn("next_d", F.lead("d").over(by_bar()))
    )


def features(candles: DataFrame, max_age: int = 2, last_only: bool = False, strategy: str | None = None, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(bar_features, of the last bars only if so asked; extremes of each symbol), each computed once, from tables.

    With a strategy only what that reads, and more, is computed and written; mean reversion reads no extremes.
    """
    if last_only and strategy in ("swing", "breakout"):  # all that these read is in the state of a symbol: one pass, without windows
        last = written(live_features(initial_state(candles).withColumn("opened", F.lit(True))), "features")
        return last.select("symbol_id", *CANDLE, *NEEDED[strategy], *more), last.select("symbol_id", "lows", "highs")
    zones = strategy != "meanrev"
    bars = written(candles, "candles") if zones else candles
    rows = bar_features(bars, max_age, strategy, more)
    return written(latest(rows) if last_only else rows, "features"), extremes_of(extrema(bars)) if zones else None


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails (is true); null if none does."""
    return F.coalesce(*[F.when(failed, name) for name, failed in checks])


def over(value: Column, limit: float | None) -> Column:
    return F.lit(False) if limit is None else value > F.lit(limit)


#: Symbols up to which their sectors are broadcast to their bars.
BROADCAST_SYMBOLS = 1_000_000


def with_strength(rows: DataFrame, bench: DataFrame, sectors: DataFrame, sector_returns: DataFrame, lookback: int = 20) -> DataFrame:
    """rows with gained, a bar's return over lookback bars less the benchmark's as of its date, sector, and sector_gained, the sector's less the benchmark's.

    bench is (d, close); sectors (symbol_id, sector), a symbol a row; sector_returns (sector, d,
    sector_ret).  The last two are null where the symbol has no sector; a gain is null where either
    return isn't known.
    """
    past = F.col(f"close{lookback}") if f"close{lookback}" in rows.columns else F.lag("close", lookback).over(by_bar())
    market = with_return(bench, lookback, name="bench_ret").select(F.lit(1).alias("k"), "d", "bench_ret")
    per_date = asof(rows.select("d").distinct().withColumn("k", F.lit(1)), market, ["k"], "d", ["bench_ret"]).drop("k")
    sectors = sectors.select("symbol_id", "sector")
    few = sectors.limit(BROADCAST_SYMBOLS + 1).count() <= BROADCAST_SYMBOLS
    # bars stay where they are: what is known of a date, or of a sector on it, is a row a date
    mapped = rows.withColumn("_ret", F.when(past > 0, (F.col("close") - past) / past * 100)).join(F.broadcast(sectors) if few else sectors, "symbol_id", "left").join(F.broadcast(per_date), "d")
    per_sector = asof(mapped.select("sector", "d").filter("sector is not null").distinct(), sector_returns, ["sector"], "d", ["sector_ret"])
    known = mapped.join(F.broadcast(per_sector), ["sector", "d"], "left")
    return known.withColumn("gained", F.col("_ret") - F.col("bench_ret")).withColumn("sector_gained", F.col("sector_ret") - F.col("bench_ret")).drop("_ret", "bench_ret", "sector_ret")


def _strength_checks(o: SwingOptions) -> list[tuple[str, Column]]:
    """On columns of with_strength, which are read only where they are asked for."""
    checks = []
    if o.min_strength is not None:
        checks += [("strength_missing", F.col("gained").isNull()), ("strength_low", F.col("gained") < o.min_strength)]
    if o.min_sector_strength is not None:
        missing = F.col("sector").isNotNull() & F.col("sector_gained").isNull()
        checks += [("sector_missing", missing)] * o.sector_strict + [("sector_low", F.col("sector_gained") < o.min_sector_strength)]
    return checks


def swing(rows: DataFrame, extremes: DataFrame, o: SwingOptions = SwingOptions()) -> DataFrame:
    """Pullbacks to support in an up-trend: rows of features with reason (null for a signal), the setup and score."""
    price = F.col("close")
    early = first_reason([
        ("few_candles", F.col("bar") < o.min_candles),
        ("not_bullish", F.col("trend") != "bullish"),
        ("ema_margin", F.lit(False) if o.ema_margin_pct is None else pct_from(price, F.col("ema200")) < o.ema_margin_pct),
        ("ema200_declining", (F.col("bar") >= 200 + o.slope_period) & (F.col("ema200") < F.col("ema200_past")) if o.slope_period else F.lit(False)),
        *_strength_checks(o),
        ("bearish_candle", F.lit(False) if o.allow_bearish_candle else price < F.col("open")),
    ])
    rows = rows.withColumn("early", early)
    # zones are dear: only where the cheap checks pass
    rows = with_nearest(rows, extremes, F.col("early").isNull(), o.min_resistance_touches)
    rows = rows.withColumn("resistance", F.when(F.col("support").isNotNull(), F.col("resistance")))
    buffer = F.when(F.col("atr14") > 0, F.lit(o.atr_multiplier) * F.col("atr14"))
    rows = (
        rows.withColumn("entry", round2(price))
        .withColumn("sl", round2(F.coalesce(F.col("support.low") - buffer, F.col("support.low") * F.lit(1 - o.stop_buffer_pct))))
        .withColumn("target", round2(F.col("resistance.mid")))
        .withColumn("risk", round2(F.col("entry") - F.col("sl")))
        .withColumn("reward", round2(F.col("target") - F.col("entry")))
        .withColumn("rr", F.when(F.col("risk") > 0, round2(F.col("reward") / F.when(F.col("risk") > 0, F.col("risk")))))
        .withColumn("risk_pct", F.col("risk") / F.col("entry") * 100)
        .withColumn("short_sl", round2(F.coalesce(F.col("resistance.high") + buffer, F.col("resistance.high") * F.lit(1 + o.stop_buffer_pct))))
        .withColumn("ext_ema10", pct_from(price, F.col("ema10")))
        .withColumn("ext_ema50", pct_from(price, F.col("ema50")))
        .withColumn("ext_support", pct_from(price, F.col("support.high")))
        .withColumn("move10", pct_from(price, F.col("close10")))
    )
    extended = over(F.col("ext_ema10"), o.max_ema10_pct) | over(F.col("ext_ema50"), o.max_ema50_pct) | over(F.col("ext_support"), o.max_support_pct) | over(F.col("move10"), o.max_move10_pct)
    late = first_reason([
        ("no_support", F.col("support").isNull()),
        ("no_resistance", F.col("resistance").isNull()),
        ("zones_overlap", (F.col("support.mid") >= F.col("resistance.mid")) | (F.col("support.high") >= F.col("resistance.low"))),
        ("out_of_range", (price <= F.col("support.low")) | (price >= F.col("resistance.high"))),
        ("zero_risk", (F.col("risk") <= 0) | (round2(F.col("short_sl") - F.col("entry")) <= 0)),
        ("zero_reward", (F.col("reward") <= 0) | (round2(F.col("entry") - round2(F.col("support.mid"))) <= 0)),
        ("rr_low", F.col("rr") < o.min_rr),
        ("risk_high", over(F.col("risk_pct"), o.max_risk_pct)),
        ("risk_low", F.lit(False) if o.min_risk_pct is None else F.col("risk_pct") < o.min_risk_pct),
        ("extended", extended),
        ("illiquid", (F.col("avg_volume") > 0) & (F.col("avg_volume") < o.min_avg_volume) if o.min_avg_volume else F.lit(False)),
    ])
    rows = rows.withColumn("reason", F.coalesce("early", late)).drop("early").withColumn("quality", rr_grade(F.col("rr")))
    return rows.withColumn("score", F.when(F.col("reason").isNull(), swing_score()))


def volume_score() -> Column:
    ratio = F.col("volume_ratio")
    return F.when(F.col("avg_volume") <= 0, F.lit(0.0)).when(ratio >= 1.5, F.lit(10.0)).when(ratio <= 1.0, F.lit(0.0)).otherwise((ratio - F.lit(1.0)) / F.lit(0.5) * F.lit(10.0))


def swing_score() -> Column:
    """40 for the trend, 30 for risk and reward, 20 for touches, 10 for volume, 5 less for a red candle."""
    trend = F.when(F.col("trend") == "bullish", 40.0).when(F.col("trend") == "neutral", 20.0).otherwise(0.0)
    rr = F.when(F.col("quality") == "excellent", 30.0).when(F.col("quality") == "good", 22.5).when(F.col("quality") == "fair", 12.0).otherwise(0.0)
    touches = F.least(F.col("support.touches"), F.lit(4)) / F.lit(4.0) * F.lit(20.0)
    candle = F.when((F.col("open") > 0) & (F.col("close") < F.col("open")), F.lit(-5.0)).otherwise(F.lit(0.0))
    return trend + rr + touches + volume_score() + candle


def breakout(rows: DataFrame, extremes: DataFrame, o: SwingOptions = SwingOptions()) -> DataFrame:
    """Prices just below resistance in a constructive trend: rows with reason, distance_pct and score."""
    price = F.col("close")
    constructive = (F.col("trend") == "bullish") | F.coalesce((price > F.col("ema50")) & (F.col("ema50") >= F.col("ema200")), F.lit(False))
    rows = with_nearest(rows.withColumn("constructive", constructive), extremes, F.col("constructive"), o.min_resistance_touches)
    rows = rows.withColumn("resistance", F.when(F.col("support").isNotNull(), F.col("resistance")))
    rows = rows.withColumn("distance_pct", F.when(price > 0, (F.col("resistance.low") - price) / price * 100))
    extended = over(pct_from(price, F.col("ema10")), o.max_ema10_pct) | over(pct_from(price, F.col("ema50")), o.max_ema50_pct) | over(pct_from(price, F.col("close10")), o.max_move10_pct)
    reason = first_reason([
        ("not_constructive", ~F.col("constructive")),
        ("no_support", F.col("support").isNull()),
        ("no_resistance", F.col("resistance").isNull()),
        ("too_far", F.col("distance_pct") > o.max_breakout_pct),
        ("extended", extended),
        ("illiquid", (F.col("avg_volume") > 0) & (F.col("avg_volume") < o.min_avg_volume) if o.min_avg_volume else F.lit(False)),
    ])
    proximity = F.least(F.greatest(F.lit(1.0) - F.col("distance_pct") / F.lit(o.max_breakout_pct), F.lit(0.0)), F.lit(1.0)) * F.lit(40.0)
    touches = F.least(F.col("resistance.touches"), F.lit(4)) / F.lit(4.0) * F.lit(30.0)
    volume = F.when(F.col("volume_ratio") >= 1.5, 10.0).when(F.col("volume_ratio") >= 1.0, 5.0).otherwise(0.0)
    score = proximity + touches + F.when(F.col("trend") == "bullish", 20.0).otherwise(10.0) + volume
    return rows.withColumn("reason", reason).withColumn("breakout_price", F.col("resistance.high")).withColumn("score", F.when(F.col("reason").isNull(), score)).drop("constructive")


def crossover(rows: DataFrame, extremes: DataFrame, o: CrossOptions = CrossOptions()) -> DataFrame:
    """Fresh crossings of ema7 over ema21: rows with reason, entry, sl, target, rr and score."""
    price = F.col("close")
    strength = F.coalesce(close_strength(F.col("high"), F.col("low"), price) < o.min_close_strength, F.lit(False)) if o.min_close_strength else F.lit(False)
    early = first_reason([
        ("few_candles", F.col("bar") < o.min_candles),
        ("not_above", F.col("ema7") <= F.col("ema21")),
        ("no_recent_cross", F.col("cross_age").isNull()),
        ("close_weak", strength),
    ])
    sl = F.least(F.col("crossed.prior_low"), price * F.lit(1 - o.min_risk_pct / 100)) if o.min_risk_pct else F.col("crossed.prior_low")
    rows = rows.withColumn("early", early).withColumn("entry", price).withColumn("sl", sl)
    rows = with_nearest(rows, extremes, F.col("early").isNull(), 1, o.min_target_pct)
    rows = rows.withColumn("target", F.when(price > F.col("sl"), F.col("resistance.mid"))).drop("support", "resistance")
    rows = rows.withColumn("rr", F.when(price > F.col("sl"), (F.col("target") - price) / (price - F.col("sl"))))
    surge = F.coalesce(F.col("volume") < F.col("surge_volume") * o.min_surge, F.lit(False)) if o.min_surge else F.lit(False)
    reason = F.coalesce("early", first_reason([
        ("below_stop", price <= F.col("sl")),
        ("no_target", F.col("target").isNull()),
        ("rr_low", F.col("rr") < o.min_rr),
        ("no_surge", surge),
    ]))
    fresh = F.when(F.col("cross_age") == 0, 40.0).when(F.col("cross_age") == 1, 30.0).otherwise(20.0)
    rr = F.when(F.col("rr") >= 3, 30.0).when(F.col("rr") >= 2, 22.0).when(F.col("rr") >= 1.5, 12.0).otherwise(0.0)
    average = F.col("crossed.avg_volume")
    ratio = F.when(average > 0, F.col("crossed.volume") / average)
    volume = F.when(average == 0, 5.0).when(ratio >= 2, 20.0).when(ratio >= 1.5, 15.0).when(ratio >= 1, 10.0).otherwise(0.0)
    gap = (F.col("ema7") - F.col("ema21")) / price * 100
    score = fresh + rr + volume + F.when(gap >= 1, 10.0).when(gap >= 0.5, 5.0).otherwise(0.0)
    return rows.withColumn("reason", reason).drop("early").withColumn("cross_volume_ratio", ratio).withColumn("score", F.when(F.col("reason").isNull(), score))


def meanrev(rows: DataFrame, o: MeanRevOptions = MeanRevOptions()) -> DataFrame:
    """Washouts within an up-trend: rows with reason, entry, sl, target and score."""
    price = F.col("close")
    rows = rows.withColumn("entry", price).withColumn("sl", price - F.lit(o.stop_atr) * F.col("atr14")).withColumn("target", F.col("ema10"))
    reason = first_reason([
        ("few_candles", F.col("bar") < o.min_candles),
        ("no_trend", price <= F.col("ema200")),
        ("not_oversold", F.col("rsi2") >= o.max_rsi),
        ("target_below", F.col("target") <= price),
        ("no_atr", F.coalesce(F.col("atr14") <= 0, F.lit(True))),
        ("bad_stop", (F.col("sl") <= 0) | (F.col("sl") >= price)),
    ])
    depth = F.least(F.greatest((F.lit(o.max_rsi) - F.col("rsi2")) / F.lit(o.max_rsi), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("reason", reason).withColumn("score", F.when(F.col("reason").isNull(), F.lit(50.0) + depth * F.lit(50.0)))


#: Strategies by name, each from features and extremes to judged rows.
STRATEGIES = {"swing": swing, "crossover": crossover, "meanrev": lambda rows, extremes: meanrev(rows)}


def within(rows: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of features from since to until, both within: for a strategy, so that others get no zones; what each knows of its past stays."""
    for day, later in ((since, True), (until, False)):
        if day is not None:
            rows = rows.filter(F.col("d") >= F.lit(day).cast("date") if later else F.col("d") <= F.lit(day).cast("date"))
    return rows


def backscan(judged: DataFrame, min_score: float | None = None) -> DataFrame:
    """Signals of judged rows, of min_score at least, that can be entered at the next bar's open (its close, if there is none)."""
    judged = judged if min_score is None else judged.filter(F.col("score") >= min_score)
    entry = F.when(F.col("next_open") > 0, F.col("next_open")).otherwise(F.col("next_close"))
    signals = judged.filter("reason is null and next_open is not null").select(
        "symbol_id", F.col("bar").alias("signal_bar"), F.col("d").alias("signal_date"), (F.col("bar") + 1).alias("entry_bar"), F.col("next_d").alias("entry_date"),
        entry.alias("entry"), "sl", "target", F.col("atr14").alias("atr"), "score",
    )
    return signals.filter("sl > 0 and entry > sl and not (target > 0 and entry >= target)")
