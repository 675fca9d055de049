"""Registered queries on scans, labelled signals, logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import round4
from ..operators import asof
from ..operators import indicators as I
from ..operators import labels as L
from ..operators import logs, scans
from ..operators import statistics as T
from ..sources import fixtures as fx
from ..sources.shared import shared_path, written
from ..sources.snapshots import purge_log
from .oracles import EXT, FEAT, IND, r4, sql, zones
from .queries import BENCH, BREC, RET, SECTOR, _bars, _bench_ind, _feat, _ind, query, rounded

# Scans

EXTENDED = "(close - ema10) / ema10 * 100 > 8 or (close - ema50) / ema50 * 100 > 15 or (close - sup.high) / sup.high * 100 > 5 or coalesce((close - close10) / close10 * 100 > 12, false)"


def swing_sql(strict: bool, only: str = "true", source: str = "feat", checks: str = "") -> str:
    """sw: judged rows, from zones of the rows that pass the cheap checks; checks come before that of the candle."""
    early = "case when bar < 200 then 'few_candles' when trend <> 'bullish' then 'not_bullish'"
    if strict:
        early += " when (close - ema200) / ema200 * 100 < 1 then 'ema_margin' when bar >= 220 and ema200 < ema200_past then 'ema200_declining'" + checks + " when close < open then 'bearish_candle'"
    late = f"when rr < {'2' if strict else '1'} then 'rr_low'"
    if strict:
        late += f" when risk / entry * 100 > 8 then 'risk_high' when risk / entry * 100 < 1.5 then 'risk_low' when {EXTENDED} then 'extended'"
    return f"""se as materialized (select *, {early} end early from {source} where {only}),
{zones("select symbol_id, bar from se where early is null")},
zs as (select symbol_id, bar, arg_max(z, z.mid) sup from (select z.symbol_id, z.bar, z, f.close from zones z join feat f using (symbol_id, bar) where z.kind = 'low') where z.high < close group by 1, 2),
zh as (select symbol_id, bar, arg_min(z, z.mid) res from (select z.symbol_id, z.bar, z, f.close from zones z join feat f using (symbol_id, bar) where z.kind = 'high') where z.low > close and z.touches >= 2 group by 1, 2),
s1 as (select se.*, sup, res, round(close * 100) / 100 entry, round(coalesce(sup.low - case when atr14 > 0 then 1.5::double * atr14 end, sup.low * '0.995'::double) * 100) / 100 sl, round(res.mid * 100) / 100 target,
         round(coalesce(res.high + case when atr14 > 0 then 1.5::double * atr14 end, res.high * '1.005'::double) * 100) / 100 short_sl
       from se left join zs using (symbol_id, bar) left join zh using (symbol_id, bar)),
s2 as (select *, round((entry - sl) * 100) / 100 risk, round((target - entry) * 100) / 100 reward from s1),
s3 as (select *, case when risk > 0 then round(reward / risk * 100) / 100 end rr from s2),
s4 as (select *, coalesce(early, case when sup is null then 'no_support' when res is null then 'no_resistance' when sup.mid >= res.mid or sup.high >= res.low then 'zones_overlap'
    when close <= sup.low or close >= res.high then 'out_of_range' when risk <= 0 or round((short_sl - entry) * 100) / 100 <= 0 then 'zero_risk'
    when reward <= 0 or round((entry - round(sup.mid * 100) / 100) * 100) / 100 <= 0 then 'zero_reward' {late} end) reason from s3),
sw as materialized (select *, case when reason is null then 40 + case when rr >= 3 then 30 when rr >= 2 then 22.5 when rr >= 1.5 then 12 else 0 end::double + least(sup.touches, 4) / 4::double * 20
    + case when avg_volume <= 0 then 0 when volume_ratio >= 1.5 then 10 when volume_ratio <= 1 then 0 else (volume_ratio - 1) / 0.5::double * 10 end + case when close < open then -5 else 0 end end score from s4)"""


BASE = (IND, FEAT, EXT)
LAST = "bar = last_bar"


@query(sql(f"select symbol_id, close, trend, reason, {r4('score')} from sw", *BASE, swing_sql(True, LAST)))
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scans.swing(*_feat(spark, sf_dir, True, "swing")).select("symbol_id", "close", "trend", "reason", "score"), "score")


@query(sql(f"select symbol_id, entry, sl, target, rr, reason, {r4('score')} from sw", *BASE, swing_sql(False, LAST)))
def scan_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.swing(*_feat(spark, sf_dir, True, "swing"), scans.LENIENT).select("symbol_id", "entry", "sl", "target", "rr", "reason", "score")
    return written(rounded(found, "score"), "found").orderBy(F.desc_nulls_last("score"), "symbol_id")  # a sort reads its input twice


#: Of each bar what it gained on the benchmark, and what its sector did; sector 3 is mapped to no index, and a third of the dates of sector 1 are missing.
STRENGTH = """smap3 as (select * from smap where sector <> 3), xret3 as (select * from xret where sector <> 1 or d >= date '1997-06-01'),
strong as (select s.symbol_id, s.bar, s.stock_ret - b.bench_ret gained from sret s asof left join bret b on s.d >= b.d),
secs as (select c.symbol_id, c.bar, c.sector, x.stock_ret - b.bench_ret sector_gained from (select c.*, sector from candles c join smap3 using (symbol_id)) c asof left join xret3 x on x.sector = c.sector and c.d >= x.d asof left join bret b on c.d >= b.d),
featx as materialized (select f.*, gained, sector, sector_gained from feat f join strong using (symbol_id, bar) left join secs using (symbol_id, bar))"""
STRENGTH_CHECKS = " when gained is null then 'strength_missing' when gained < 0 then 'strength_low' when sector is not null and sector_gained is null then 'sector_missing' when sector_gained < 0.5 then 'sector_low'"


def _strong(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Features of the swing scan with what STRENGTH tells of each bar, and extremes."""
    sectors = fx.sector_map(spark, sf_dir)
    rows, extremes = scans.features(fx.candles(spark, sf_dir), strategy="swing", more=("close20",))
    closes = rows.select("symbol_id", "d", "close")  # from the table, so that candles are made once
    bench = written(fx.bench_index(closes), "bench")
    index = written(asof.with_return(fx.sector_index(closes, sectors), 20, "sector", name="sector_ret").filter("sector <> 1 or d >= date'1997-06-01'"), "sector-index")
    return scans.with_strength(rows, bench, sectors.filter("sector <> 3"), index), extremes


@query(sql("select reason, count(*)::bigint n from sw group by 1", BENCH, RET, SECTOR, *BASE, STRENGTH, swing_sql(True, source="featx", checks=STRENGTH_CHECKS)))
def swing_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """swing_filters with the strength against the benchmark and the sector's, missing data of a mapped sector rejected."""
    rows, extremes = _strong(spark, sf_dir)
    options = scans.SwingOptions(min_strength=0.0, min_sector_strength=0.5, sector_strict=True)
    return scans.swing(rows, extremes, options).groupBy("reason").agg(F.count("*").alias("n"))


@query(sql("select reason, count(*)::bigint n from sw group by 1", *BASE, swing_sql(True)))
def swing_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.swing(*_feat(spark, sf_dir, strategy="swing")).groupBy("reason").agg(F.count("*").alias("n"))


@query(sql("select symbol_id, bar, entry, sl, target, risk, reward, rr from sw where reason is null", *BASE, swing_sql(False)))
def setup_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.swing(*_feat(spark, sf_dir, strategy="swing"), scans.LENIENT).filter("reason is null").select("symbol_id", "bar", "entry", "sl", "target", "risk", "reward", "rr")


@query(sql("select symbol_id, bar, short_sl, round(sup.mid * 100) / 100 short_target, round((round((entry - round(sup.mid * 100) / 100) * 100) / 100) / (round((short_sl - entry) * 100) / 100) * 100) / 100 short_rr from sw where reason is null", *BASE, swing_sql(False)))
def setup_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.swing(*_feat(spark, sf_dir, strategy="swing"), scans.LENIENT).filter("reason is null")
    target = S.round2(F.col("support.mid"))
    rr = S.round2(S.round2(F.col("entry") - target) / S.round2(F.col("short_sl") - F.col("entry")))
    return rows.select("symbol_id", "bar", "short_sl", target.alias("short_target"), rr.alias("short_rr"))


@query(sql(f"select symbol_id, bar, {r4('score')}, case when rr >= 3 then 'excellent' when rr >= 2 then 'good' when rr >= 1.5 then 'fair' else 'poor' end quality from sw where reason is null", *BASE, swing_sql(False)))
def score_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.swing(*_feat(spark, sf_dir, strategy="swing"), scans.LENIENT).filter("reason is null")
    return rounded(rows.select("symbol_id", "bar", "score", "quality"), "score")


BREAKOUT = f"""be as materialized (select *, trend = 'bullish' or coalesce(close > ema50 and ema50 >= ema200, false) good from feat where {LAST}),
{zones("select symbol_id, bar from be where good")},
bz as (select be.*, (select arg_max(z, z.mid) from zones z where z.symbol_id = be.symbol_id and z.kind = 'low' and z.high < be.close) sup,
              (select arg_min(z, z.mid) from zones z where z.symbol_id = be.symbol_id and z.kind = 'high' and z.low > be.close and z.touches >= 2) res from be),
b1 as (select *, (res.low - close) / close * 100 distance_pct from bz),
bo as (select *, case when not good then 'not_constructive' when sup is null then 'no_support' when res is null then 'no_resistance' when distance_pct > 3 then 'too_far'
   when (close - ema10) / ema10 * 100 > 8 or (close - ema50) / ema50 * 100 > 15 or coalesce((close - close10) / close10 * 100 > 12, false) then 'extended' end reason,
   least(greatest(1 - distance_pct / 3, 0), 1) * 40 + least(res.touches, 4) / 4::double * 30 + case when trend = 'bullish' then 20 else 10 end + case when volume_ratio >= 1.5 then 10 when volume_ratio >= 1 then 5 else 0 end sc from b1)"""


@query(sql(f"select symbol_id, reason, case when sup is not null then round(distance_pct * 10000) / 10000 end distance_pct, case when reason is null then round(sc * 10000) / 10000 end score from bo", *BASE, BREAKOUT))
def scan_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.breakout(*_feat(spark, sf_dir, True, "breakout")).select("symbol_id", "reason", "distance_pct", "score")
    return written(rounded(found, "distance_pct", "score"), "found").orderBy(F.desc_nulls_last("score"), "distance_pct", "symbol_id")  # a sort reads its input twice


def cross_sql(only: str = "true") -> str:
    return f"""ce as materialized (select f.*, x.prior_low cross_low, x.volume cross_vol, x.avg_volume cross_avg, f.bar - f.cross_bar cross_age,
    least(x.prior_low, f.close * '0.97'::double) sl from (select * from feat where {only}) f left join feat x on x.symbol_id = f.symbol_id and x.bar = f.cross_bar),
{zones("select symbol_id, bar from ce where bar >= 50 and cross_age is not null")},
ct as (select c.symbol_id, c.bar, min(z.mid) target from ce c join zones z on z.symbol_id = c.symbol_id and z.bar = c.bar and z.kind = 'high' and z.low > c.close and z.mid >= c.close * '1.04'::double where c.close > c.sl group by 1, 2),
c1 as (select ce.*, target, case when close > sl then (target - close) / (close - sl) end rr from ce left join ct using (symbol_id, bar)),
cr as materialized (select *, case when bar < 50 then 'few_candles' when ema7 <= ema21 then 'not_above' when cross_age is null then 'no_recent_cross' when close <= sl then 'below_stop'
    when target is null then 'no_target' when rr < 1.5 then 'rr_low' end reason,
  case when cross_age = 0 then 40 when cross_age = 1 then 30 else 20 end + case when rr >= 3 then 30 when rr >= 2 then 22 when rr >= 1.5 then 12 else 0 end
    + case when cross_avg = 0 then 5 when cross_vol / cross_avg >= 2 then 20 when cross_vol / cross_avg >= 1.5 then 15 when cross_vol / cross_avg >= 1 then 10 else 0 end
    + case when (ema7 - ema21) / close * 100 >= 1 then 10 when (ema7 - ema21) / close * 100 >= 0.5 then 5 else 0 end::double sc from c1)"""


@query(sql(f"select symbol_id, reason, cross_age, {r4('case when cross_age is not null then sl end', 'sl')}, target, {r4('rr')}, case when reason is null then sc end score from cr", *BASE, cross_sql(LAST)))
def scan_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.crossover(*_feat(spark, sf_dir, True, "crossover")).select("symbol_id", "reason", "cross_age", F.when(F.col("crossed").isNotNull() & F.col("cross_age").isNotNull(), F.col("sl")).alias("sl"), "target", "rr", "score")
    return written(rounded(found, "sl", "rr"), "found").orderBy(F.desc_nulls_last("score"), "cross_age", "symbol_id")  # a sort reads its input twice


MEANREV = """mr as materialized (select *, close - 2.5::double * atr14 sl, case when bar < 210 then 'few_candles' when close <= ema200 then 'no_trend' when rsi2 >= 10 then 'not_oversold' when ema10 <= close then 'target_below'
  when coalesce(atr14 <= 0, true) then 'no_atr' when close - 2.5::double * atr14 <= 0 or close - 2.5::double * atr14 >= close then 'bad_stop' end reason, 50 + least(greatest((10 - rsi2) / 10, 0), 1) * 50 sc from feat)"""


@query(sql(f"select symbol_id, reason, {r4('sl')}, {r4('case when reason is null then sc end', 'score')} from mr where {LAST}", IND, FEAT, MEANREV))
def scan_meanrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.meanrev(I.latest(_bars(spark, sf_dir, "meanrev"))).select("symbol_id", "reason", "sl", "score")
    return rounded(found, "sl", "score").orderBy(F.desc_nulls_last("score"), "symbol_id")


@query(sql("select 'meanrev' strategy, coalesce(reason, 'signal') reason, count(*)::bigint n from mr group by 2 union all select 'crossover', coalesce(reason, 'signal'), count(*)::bigint from cr group by 2", *BASE, MEANREV, cross_sql()))
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, extremes = _feat(spark, sf_dir, strategy="crossover", more=tuple(c for c in scans.NEEDED["meanrev"] if c not in scans.NEEDED["crossover"]))
    parts = [scans.STRATEGIES[name](rows, extremes).select(F.lit(name).alias("strategy"), F.coalesce("reason", F.lit("signal")).alias("reason")) for name in ("meanrev", "crossover")]
    return parts[0].unionByName(parts[1]).groupBy("strategy", "reason").agg(F.count("*").alias("n"))


@query(sql(f"select symbol_id, bar, {r4('sc', 'score')}, sc >= 85 alert from mr where reason is null order by sc desc, symbol_id, bar limit 20", IND, FEAT, MEANREV))
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.meanrev(_bars(spark, sf_dir, "meanrev")).filter("reason is null").orderBy(F.desc("score"), "symbol_id", "bar").limit(20)
    return found.select("symbol_id", "bar", round4(F.col("score")).alias("score"), (F.col("score") >= 85).alias("alert"))


# Signals on every bar, and their outcomes

ENTER = "select symbol_id, bar signal_bar, d signal_date, bar + 1 entry_bar, next_d entry_date, case when next_open > 0 then next_open else next_close end entry, sl, {target} target, atr14 atr, {score} score from {rows} where reason is null and next_open is not null"


def signals_sql(rows: str, target: str, score: str) -> str:
    return f"sig as materialized (select * from ({ENTER.format(rows=rows, target=target, score=score)}) where sl > 0 and entry > sl and not coalesce(target > 0 and entry >= target, false))"


CROSS_SIGNALS = (*BASE, cross_sql(), signals_sql("cr", "target", "sc"))
REV_SIGNALS = (IND, FEAT, MEANREV, signals_sql("mr", "ema10", "sc"))
SHOWN = f"select symbol_id, signal_bar, entry_date, entry, {r4('sl')}, {r4('target')}, {r4('score')} from sig"


def _show(signals: DataFrame) -> DataFrame:
    return rounded(signals.select("symbol_id", "signal_bar", "entry_date", "entry", "sl", "target", "score"), "sl", "target", "score")


def _signals(spark: SparkSession, sf_dir: str, strategy: str = "crossover", more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    rows, extremes = _feat(spark, sf_dir, strategy=strategy, more=more)
    return scans.backscan(scans.STRATEGIES[strategy](rows, extremes)), rows


@query(sql(SHOWN, *CROSS_SIGNALS))
def backscan_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(_signals(spark, sf_dir)[0])


@query(sql(SHOWN, *REV_SIGNALS))
def backscan_meanrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(scans.backscan(scans.meanrev(_bars(spark, sf_dir, "meanrev"))))


@query(sql(SHOWN, *BASE, swing_sql(False), signals_sql("sw", "target", "score")))
def backscan_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(scans.backscan(scans.swing(*_feat(spark, sf_dir, strategy="swing"), scans.LENIENT)))


@query(sql(SHOWN + " where signal_date between date '1995-06-01' and date '1997-03-31' and score >= 70", *CROSS_SIGNALS))
def backscan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossover signals of some dates, of a score of 70 or more."""
    rows, extremes = _feat(spark, sf_dir)
    return _show(scans.backscan(scans.crossover(scans.within(rows, "1995-06-01", "1997-03-31"), extremes), 70.0))


BARRIER = """held as (select s.*, c.bar, c.d bar_date, c.low bar_low, c.high bar_high, c.close bar_close from sig s join candles c on c.symbol_id = s.symbol_id and c.bar between s.entry_bar and s.entry_bar + 19),
hit as (select symbol_id, signal_bar, min(case when bar_low <= sl then bar end) sb, min(case when bar_high >= target then bar end) tb, max(bar) lb, arg_max(bar_close, bar) lc from held group by 1, 2),
tr0 as (select s.*, case when sb is not null and (tb is null or sb <= tb) then 'loss' when tb is not null then 'win' else 'timeout' end outcome,
         case when sb is not null and (tb is null or sb <= tb) then sb when tb is not null then tb else lb end exit_bar,
         case when sb is not null and (tb is null or sb <= tb) then sl when tb is not null then target else lc end exit_price from sig s join hit using (symbol_id, signal_bar)),
trades as materialized (select t.*, c.d exit_date, (exit_price - entry) / (entry - sl) actual_rr, exit_bar - entry_bar + 1 hold_days from tr0 t join candles c on c.symbol_id = t.symbol_id and c.bar = t.exit_bar),
m as (select *, round(actual_rr * 1000000)::bigint mr from trades)"""
TRADES = (*REV_SIGNALS, BARRIER)


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, rows = _signals(spark, sf_dir, "meanrev")
    return L.barrier(signals, rows)


@query(sql(f"select symbol_id, signal_bar, outcome, exit_bar, exit_date, {r4('exit_price')}, {r4('actual_rr')}, hold_days from trades", *TRADES))
def label_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_trades(spark, sf_dir).select("symbol_id", "signal_bar", "outcome", "exit_bar", "exit_date", "exit_price", "actual_rr", "hold_days"), "exit_price", "actual_rr")


TRAIL = """h0 as (select s.*, c.bar, c.low bar_low, c.high bar_high, c.close bar_close, greatest(s.entry, max(c.high) over (partition by s.symbol_id, s.signal_bar order by c.bar rows between unbounded preceding and 1 preceding)) peak
  from sig s join candles c on c.symbol_id = s.symbol_id and c.bar between s.entry_bar and s.entry_bar + 19),
h1 as (select *, greatest(sl, case when peak > entry and atr > 0 then peak - 1.5::double * atr end) stop from h0),
h2 as (select symbol_id, signal_bar, min(case when bar_low <= stop then bar end) sb, arg_min(stop, bar) filter (bar_low <= stop) se, min(case when bar_high >= target then bar end) tb, max(bar) lb, arg_max(bar_close, bar) lc from h1 group by 1, 2),
tt as (select s.*, case when sb is not null and (tb is null or sb <= tb) then case when se > sl then 'trail_stop' else 'loss' end when tb is not null then 'win' else 'timeout' end outcome,
         case when sb is not null and (tb is null or sb <= tb) then sb when tb is not null then tb else lb end exit_bar,
         case when sb is not null and (tb is null or sb <= tb) then se when tb is not null then target else lc end exit_price from sig s join h2 using (symbol_id, signal_bar)),
trailed as materialized (select t.*, c.d exit_date, (exit_price - entry) / (entry - sl) actual_rr, exit_bar - entry_bar + 1 hold_days from tt t join candles c on c.symbol_id = t.symbol_id and c.bar = t.exit_bar)"""


@query(sql(f"select symbol_id, signal_bar, outcome, exit_bar, {r4('exit_price')}, {r4('actual_rr')}, hold_days from trailed", *REV_SIGNALS, TRAIL))
def label_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, rows = _signals(spark, sf_dir, "meanrev")
    return rounded(L.trailing(signals, rows).select("symbol_id", "signal_bar", "outcome", "exit_bar", "exit_price", "actual_rr", "hold_days"), "exit_price", "actual_rr")


EMAEXIT = """re as (select symbol_id, bar entry_bar, min(case when ema7 < ema21 then bar end) over (partition by symbol_id order by bar rows between 1 following and unbounded following) rb, max(bar) over (partition by symbol_id) lb from ind),
h as (select s.symbol_id, s.signal_bar, s.sl, c.bar, c.low, c.close, re.rb, coalesce(rb, lb) eb from sig s join re on re.symbol_id = s.symbol_id and re.entry_bar = s.entry_bar join candles c on c.symbol_id = s.symbol_id and c.bar between s.entry_bar and coalesce(rb, lb)),
x as (select symbol_id, signal_bar, min(case when low <= sl then bar end) sb, max(bar) eb, arg_max(close, bar) ec, any_value(rb) rb from h group by 1, 2),
emat as materialized (select s.*, case when sb is not null then 'stop' when eb = rb then 'recross' else 'open' end status, coalesce(sb, eb) exit_bar, case when sb is not null then sl else ec end exit_price from sig s join x using (symbol_id, signal_bar)),
em as (select *, exit_bar - entry_bar hold_days, (exit_price * '0.998'::double * '0.99875'::double / (entry * '1.002'::double * '1.00125'::double) - 1) * 100 net_pct,
        case when entry * '1.002'::double - sl > 0 then (exit_price * '0.998'::double - entry * '1.002'::double) / (entry * '1.002'::double - sl) else 0 end actual_rr from emat)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_of(spark, sf_dir)[0]


def _held_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trades, and the table of all bars that they are of."""
    signals, rows = _signals(spark, sf_dir)
    return L.ema_exit(signals, rows), rows


@query(sql(f"select symbol_id, signal_bar, status, exit_bar, {r4('exit_price')}, {r4('actual_rr')}, hold_days from em", *CROSS_SIGNALS, EMAEXIT))
def label_ema_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_held(spark, sf_dir).select("symbol_id", "signal_bar", "status", "exit_bar", "exit_price", "actual_rr", "hold_days"), "exit_price", "actual_rr")


@query(sql("select symbol_id, signal_bar, exit_bar from nonover", *TRADES, """nr as (select symbol_id, signal_bar, exit_bar from (select *, row_number() over (partition by symbol_id order by signal_bar) k from trades) where k = 1
  union all select t.symbol_id, t.signal_bar, t.exit_bar from (select n.symbol_id, (select min(t.signal_bar) from trades t where t.symbol_id = n.symbol_id and t.signal_bar > n.exit_bar) nb from nr n) q join trades t on t.symbol_id = q.symbol_id and t.signal_bar = q.nb),
nonover as (select * from nr)"""))
def non_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.non_overlapping(_trades(spark, sf_dir)).select("symbol_id", "signal_bar", "exit_bar")


SUMMARY = """select count(*)::bigint trades, count_if(outcome = 'win')::bigint wins, count_if(outcome = 'loss')::bigint losses, count_if(outcome = 'timeout')::bigint timeouts, count_if(outcome = 'trail_stop')::bigint trail_stops,
  round(coalesce(count_if(outcome = 'win') / nullif(count_if(outcome = 'win') + count_if(outcome = 'loss'), 0)::double * 100, 0) * 10000) / 10000 win_rate,
  round(coalesce(sum(case when outcome = 'win' then mr end)::bigint / 1e6 / nullif(count_if(outcome = 'win'), 0), 0) * 10000) / 10000 avg_win_rr,
  round(coalesce(sum(case when outcome = 'loss' then mr end)::bigint / 1e6 / nullif(count_if(outcome = 'loss'), 0), 0) * 10000) / 10000 avg_loss_rr,
  round(coalesce(sum(case when outcome = 'trail_stop' then mr end)::bigint / 1e6 / nullif(count_if(outcome = 'trail_stop'), 0), 0) * 10000) / 10000 avg_trail_rr,
  round(sum(case when mr > 0 then mr else 0 end)::bigint / nullif(-sum(case when mr < 0 then mr else 0 end)::bigint, 0)::double * 10000) / 10000 profit_factor,
  round(sum(mr)::bigint / 1e6 / count(*) * 10000) / 10000 expectancy, round(sum(hold_days)::bigint / count(*)::double * 10000) / 10000 avg_hold_days from {0}"""


@query(sql(SUMMARY.format("(select *, round(actual_rr * 1000000)::bigint mr from trailed)"), *REV_SIGNALS, TRAIL))
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, rows = _signals(spark, sf_dir, "meanrev")
    return L.summary(L.trailing(signals, rows))


STREAK = """st as (select *, case when outcome = 'loss' or (outcome = 'trail_stop' and actual_rr < 0) then 1 else 0 end step from trailed where outcome <> 'timeout'),
si as (select step, sum(1 - step) over (order by exit_date, symbol_id, signal_bar) island from st)"""


@query(sql("select coalesce(max(run), 0)::bigint max_loss_streak from (select island, sum(step) run from si group by 1)", *REV_SIGNALS, TRAIL, STREAK))
def max_loss_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, rows = _signals(spark, sf_dir, "meanrev")
    return L.max_loss_streak(L.trailing(signals, rows))


@query(sql("select count(*)::bigint trades, count_if(mr > 0)::bigint wins, count_if(mr < 0)::bigint losses, round(sum(case when mr > 0 then mr else 0 end)::bigint / nullif(-sum(case when mr < 0 then mr else 0 end)::bigint, 0)::double * 10000) / 10000 profit_factor, round(sum(mr)::bigint / 1e6 / count(*) * 10000) / 10000 avg_r, round(sum(hold_days)::bigint / count(*)::double * 10000) / 10000 avg_hold from m", *TRADES))
def portfolio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.portfolio_stats(_trades(spark, sf_dir))


RANKED = "rk as (select *, row_number() over (partition by entry_date order by score desc, symbol_id)::int rank from {0})"


@query(sql("select symbol_id, signal_bar, entry_date, rank from rk where rank <= 3", *REV_SIGNALS, RANKED.format("sig")))
def day_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.day_candidates(_signals(spark, sf_dir, "meanrev")[0], 3).filter("accepted").select("symbol_id", "signal_bar", "entry_date", "rank")


@query(sql("select symbol_id, signal_bar, entry_date, rank from (select s.*, row_number() over (partition by entry_date order by coalesce(c.close / b.close - 1, 0) desc, s.score desc, s.symbol_id)::int rank from sig s join candles c on c.symbol_id = s.symbol_id and c.bar = s.signal_bar left join candles b on b.symbol_id = s.symbol_id and b.bar = s.signal_bar - 50) where rank <= 3", *REV_SIGNALS))
def day_candidates_leadership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each day by the return of their symbol over 50 bars."""
    signals, rows = _signals(spark, sf_dir, "meanrev")
    leading = rows.select("symbol_id", F.col("bar").alias("signal_bar"), F.coalesce(F.col("close") / F.lag("close", 50).over(I.by_bar()) - 1, F.lit(0.0)).alias("leadership"))
    ranked = T.day_candidates(signals.join(leading, ["symbol_id", "signal_bar"]), 3, "leadership")
    return ranked.filter("accepted").select("symbol_id", "signal_bar", "entry_date", "rank")


@query(sql("select accepted, count(*)::bigint trades, round(sum(mr)::bigint / 1e6 / count(*) * 10000) / 10000 avg_r, round(count_if(mr > 0) / count(*)::double * 100 * 10000) / 10000 win_rate from (select *, rank <= 3 accepted from rk) group by 1", *TRADES, RANKED.format("m")))
def opportunity_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.split_stats(T.day_candidates(_trades(spark, sf_dir), 3), "accepted")


@query(sql("select distinct d from candles"))
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.candles(spark, sf_dir).select("d").distinct().orderBy("d")


GATE = """hg0 as (select exit_date, row_number() over (order by exit_date, symbol_id, signal_bar) n, sum(mr) over (order by exit_date, symbol_id, signal_bar rows between 19 preceding and current row)::bigint recent from m),
hg as (select exit_date, max(n)::bigint closed, max(n) < 20 or arg_max(recent, n) / 1e6 / 20::double >= 0 healthy from hg0 group by 1)"""


@query(sql("select exit_date, closed, healthy from hg", *TRADES, GATE))
def health_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.health(_trades(spark, sf_dir))


FACTOR = """fg0 as (select exit_date, row_number() over o n, sum(greatest(mr, 0)) over w gained, sum(least(mr, 0)) over w lost from m
  window o as (order by exit_date, symbol_id, signal_bar), w as (order by exit_date, symbol_id, signal_bar rows between 29 preceding and current row))"""


@query(sql("select exit_date, max(n)::bigint closed, max(n) < 30 or case when arg_max(lost, n) < 0 then arg_max(gained, n) / -arg_max(lost, n)::double >= 1.2::double else arg_max(gained, n) > 0 end healthy from fg0 group by 1", *TRADES, FACTOR))
def health_gate_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.health(_trades(spark, sf_dir), 30, 1.2, factor=True)


@query(sql("select n, mr / 1e6 r from (select row_number() over (order by exit_date desc, symbol_id desc, signal_bar desc)::int n, mr from m) where n <= 20", *TRADES))
def health_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _trades(spark, sf_dir).orderBy(F.desc("exit_date"), F.desc("symbol_id"), F.desc("signal_bar")).limit(20)
    n = F.row_number().over(W.orderBy(F.desc("exit_date"), F.desc("symbol_id"), F.desc("signal_bar")))
    return last.select(n.alias("n"), (L.micro("actual_rr") / F.lit(1e6)).alias("r"))


@query(sql("select gate_open, count(*)::bigint trades, round(sum(mr)::bigint / 1e6 / count(*) * 10000) / 10000 avg_r, round(count_if(mr > 0) / count(*)::double * 100 * 10000) / 10000 win_rate from (select m.*, coalesce((select arg_max(healthy, hg.exit_date) from hg where hg.exit_date < m.entry_date), true) gate_open from m) group by 1", *TRADES, GATE))
def gate_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = _trades(spark, sf_dir)
    return T.split_stats(T.gated(trades, T.health(trades)), "gate_open")


@query(sql("select gate_open, coalesce(regime, false) regime_open, count(*)::bigint trades, round(sum(mr)::bigint / 1e6 / count(*) * 10000) / 10000 avg_r, round(count_if(mr > 0) / count(*)::double * 100 * 10000) / 10000 win_rate, round(sum(case when mr > 0 then mr else 0 end)::bigint / nullif(-sum(case when mr < 0 then mr else 0 end)::bigint, 0)::double * 10000) / 10000 profit_factor from (select m.*, coalesce((select arg_max(healthy, hg.exit_date) from hg where hg.exit_date < m.entry_date), true) gate_open, coalesce(b.close > b.e200, true) and b.d is not null regime from m left join brec b on b.d = m.entry_date) group by 1, 2", BENCH, BREC, *TRADES, GATE))
def gate_effect_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades by both gates: the health of the strategy, and the benchmark above its ema200 on the entry date."""
    trades = _trades(spark, sf_dir)
    regime = _bench_ind(spark, sf_dir).select("d", F.coalesce(F.col("close") > F.col("ema200"), F.lit(True)).alias("regime_open"))
    return T.gate_stats(T.in_regime(T.gated(trades, T.health(trades)), regime), "gate_open", "regime_open")


CURVE = """cv as (select exit_date d, round(floor(10000 / entry) * (exit_price - entry) * 100)::bigint realised, 0::bigint marked, 1 exits, 0 held from trades
  union all select c.d, 0, round(floor(10000 / t.entry) * (c.close - t.entry) * 100)::bigint, 0, 1 from trades t join candles c on c.symbol_id = t.symbol_id and c.bar between t.entry_bar and t.exit_bar - 1),
eq as (select d, sum(held)::bigint open, sum(exits)::bigint exits, 1e6::double + ((sum(sum(realised)) over (order by d))::bigint + sum(marked)::bigint) / 100::double equity from cv group by 1),
dd as (select *, greatest(max(equity) over (order by d), 1e6::double) peak from eq)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, rows = _signals(spark, sf_dir, "meanrev")
    return T.equity_curve(L.barrier(signals, rows), rows)


@query(sql(f"select d, open, exits, {r4('equity')} from eq", *TRADES, CURVE))
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_curve(spark, sf_dir), "equity")


@query(sql(f"select d, {r4('peak')}, {r4('(equity - peak) / peak * 100', 'drawdown_pct')} from dd", *TRADES, CURVE))
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.drawdown(_curve(spark, sf_dir)).select("d", "peak", "drawdown_pct"), "peak", "drawdown_pct")


@query(sql("select d, (sum(s) over (order by d))::bigint open from (select d, sum(s) s from (select entry_date d, 1 s from m union all select (exit_date + interval 1 day)::date, -1 from m) group by 1)", *TRADES))
def concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.concurrency(_trades(spark, sf_dir))


@query(sql('select symbol_id, round((pow(c1 / c0, 365.25::double / n_days) - 1) * 100 * 10000) / 10000 cagr from (select symbol_id, arg_min(close, d) c0, arg_max(close, d) c1, max(d) - min(d) n_days from candles group by 1)'))
def cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = fx.candles(spark, sf_dir).groupBy("symbol_id").agg(F.min_by("close", "d").alias("first"), F.max_by("close", "d").alias("last"), F.datediff(F.max("d"), F.min("d")).alias("days"))
    return ends.select("symbol_id", round4(T.cagr(F.col("first"), F.col("last"), F.col("days"))).alias("cagr"))


@query(sql("select year(exit_date)::int \"year\", count(*)::bigint trades, round(sum(mr)::bigint / 1e6 / count(*) * 10000) / 10000 avg_r, round(count_if(mr > 0) / count(*)::double * 100 * 10000) / 10000 win_rate from m group by 1", *TRADES))
def by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.split_stats(_trades(spark, sf_dir).withColumn("year", F.year("exit_date")), "year")


ODDS = (5, 3, 0)


@query(sql("select year(d)::int \"year\", count(*)::bigint windows, " + ", ".join(f"round(count_if(gain >= {k}) / count(*)::double * 10000) / 10000 odds{k}" for k in ODDS) + f", {r4('median(gain)', 'median_gain')} from (select a.d, (arg_max(b.equity, b.d) / any_value(a.equity) - 1) * 100 gain from eq a join eq b on b.d between a.d and a.d + 45 where a.d + 45 <= (select max(d) from eq) group by a.d) group by 1", *TRADES, CURVE))
def rolling_window_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By starting year, how often the equity gains so much in 45 days, and the median gain."""
    rows = T.window_gains(_curve(spark, sf_dir), 45).groupBy(F.year("d").alias("year"))
    return rows.agg(F.count("*").alias("windows"), *[round4(F.count_if(F.col("gain") >= k) / F.count("*")).alias(f"odds{k}") for k in ODDS], round4(F.median("gain")).alias("median_gain"))


@query(sql("select d, count(*)::bigint symbols, round(count_if(ema20 > ema50) / count(*)::double * 10000) / 10000 breadth from ind where ema50 is not null group by 1", IND))
def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ind(spark, sf_dir, "ema20", "ema50").filter("ema50 is not null").groupBy("d")
    return rows.agg(F.count("*").alias("symbols"), round4(F.count_if(F.col("ema20") > F.col("ema50")) / F.count("*")).alias("breadth"))


@query(sql(f"select symbol_id, d, {r4('percent_rank() over (partition by d order by ret)', 'pct_rank')} from (select *, close / lag(close, 50) over (partition by symbol_id order by bar) - 1 ret from candles) where ret is not null"))
def xsec_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.candles(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close", 50).over(I.by_bar()) - 1).filter("ret is not null")
    return rows.select("symbol_id", "d", round4(F.percent_rank().over(W.partitionBy("d").orderBy("ret"))).alias("pct_rank"))


# Forward evaluation


@query(sql(f"select symbol_id, signal_bar, status, hold_days, {r4('net_pct')} from em", *CROSS_SIGNALS, EMAEXIT))
def eval_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_held(spark, sf_dir).select("symbol_id", "signal_bar", "status", "hold_days", "net_pct"), "net_pct")


@query(sql("""select count(*)::bigint trades, count_if(mn > 0)::bigint wins, count_if(status = 'stop')::bigint stopped, count_if(status = 'recross')::bigint recross, count_if(status = 'timeout')::bigint timeouts, count_if(status = 'open')::bigint still_open,
  count_if(status <> 'open')::bigint closed, round(sum(case when status <> 'open' then mn end)::bigint / 1e6 / count_if(status <> 'open') * 10000) / 10000 closed_avg_net,
  round(sum(mn)::bigint / 1e6 / count(*) * 10000) / 10000 avg_net, max(mn) / 1e6 best, min(mn) / 1e6 worst, list_sort(list(mn))[count(*)::int // 2 + 1] / 1e6 median_net from (select *, round(net_pct * 1000000)::bigint mn from em)""", *CROSS_SIGNALS, EMAEXIT))
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _held(spark, sf_dir).select("status", L.micro("net_pct").alias("n"))
    of = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(
        F.count("*").alias("trades"), F.count_if(F.col("n") > 0).alias("wins"), of("stop").alias("stopped"), of("recross").alias("recross"), of("timeout").alias("timeouts"), of("open").alias("still_open"),
        (F.count("*") - of("open")).alias("closed"), round4(F.sum(F.when(F.col("status") != "open", F.col("n"))) / F.lit(1e6) / F.nullif(F.count("*") - of("open"), F.lit(0))).alias("closed_avg_net"),
        round4(F.sum("n") / F.lit(1e6) / F.count("*")).alias("avg_net"), (F.max("n") / F.lit(1e6)).alias("best"), (F.min("n") / F.lit(1e6)).alias("worst"),
        (F.expr("percentile_disc(0.5) within group (order by n desc)") / F.lit(1e6)).alias("median_net"),
    )


# Logs

LOG = "slog as (select date_trunc('{0}', ts) scanned_at, user_id::bigint symbol, sum(round(value * 100)::bigint)::bigint score from events group by 1, 2)"


@query("with " + LOG.format("hour") + " select scanned_at::timestamp scanned_at, symbol, score from slog where score >= 5000 order by scanned_at desc, score desc, symbol limit 100")
def scan_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_query(fx.scan_log(spark, sf_dir), min_score=5000).select(F.col("scanned_at").cast("timestamp_ntz").alias("scanned_at"), "symbol", "score")


@query("with " + LOG.format("hour") + " select symbol, (scanned_at + interval '5 hours 30 minutes')::date as day, min(scanned_at)::timestamp scanned_at, arg_min(score, scanned_at) score from slog group by 1, 2")
def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first_appearance(fx.scan_log(spark, sf_dir)).withColumn("scanned_at", F.col("scanned_at").cast("timestamp_ntz"))


#: slog with each symbol's runs in a row.
STREAKS = "ru as (select scanned_at, row_number() over (order by scanned_at) run from (select distinct scanned_at from slog)), isl as (select *, run - row_number() over (partition by symbol order by run) island from slog join ru using (scanned_at)), stk as (select *, row_number() over (partition by symbol, island order by run)::bigint streak from isl)"
DAY = "2024-01-20"


@query("with " + LOG.format("hour") + f", {STREAKS} select symbol, score, streak from stk where scanned_at = (select max(scanned_at) from slog where (scanned_at + interval 330 minute)::date = date '{DAY}')")
def latest_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of a day's last run, with the runs in a row that have them: what a restarted scan goes on from."""
    return logs.latest_run(logs.streaks(fx.scan_log(spark, sf_dir)), DAY).select("symbol", "score", "streak")


@query("with " + LOG.format("hour") + " select count_if(scanned_at >= l)::bigint kept, count_if(scanned_at < l)::bigint purged from slog, (select max(scanned_at) - interval 10 day l from slog)")
def scan_results_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a log by date after ten days are kept, as read again, and what is gone."""
    path = shared_path(spark, "scan-log")
    fx.scan_log(spark, sf_dir).withColumn("scan_date", F.col("scanned_at").cast("date")).write.partitionBy("scan_date").parquet(path)
    last = spark.read.parquet(path).agg(F.max("scanned_at") - F.make_dt_interval(F.lit(10))).collect()[0][0]
    purged = purge_log(spark, path, last.isoformat(" ")).select("purged")
    return spark.read.parquet(path).agg(F.count("*").alias("kept")).join(F.broadcast(purged))


@query("with " + LOG.format("day") + ", ru as (select scanned_at, row_number() over (order by scanned_at) run from (select distinct scanned_at from slog)), j as (select *, run - row_number() over (partition by symbol order by run) island from slog join ru using (scanned_at)), k as (select *, row_number() over (partition by symbol, island order by run)::bigint streak from j) select scanned_at::date as day, symbol, streak, streak = 1 and run > 1 is_new from k")
def scan_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.streaks(fx.scan_log(spark, sf_dir, "day")).select(F.col("scanned_at").cast("date").alias("day"), "symbol", "streak", "is_new")


TARGETED = """th as (select s.*, c.bar, c.low low_, c.high high_, c.close close_ from sig s join candles c on c.symbol_id = s.symbol_id and c.bar between s.entry_bar and s.entry_bar + 40),
tx as (select symbol_id, signal_bar, min(case when low_ <= sl then bar end) sb, min(case when target > 0 and high_ >= target and bar > entry_bar then bar end) tb, max(bar) lb, arg_max(close_, bar) lc from th group by 1, 2),
tm as (select s.*, case when sb is not null and sb <= coalesce(tb, sb) then 'stop' when tb is not null then 'target' when lb - entry_bar >= 40 then 'timeout' else 'open' end status, lb, lc, sb, tb from sig s join tx using (symbol_id, signal_bar)),
tm2 as (select *, case status when 'stop' then sb when 'target' then tb else lb end exit_bar, case status when 'stop' then sl when 'target' then target else lc end exit_price from tm)"""


@query(sql(f"select symbol_id, signal_bar, status, exit_bar, {r4('exit_price')}, exit_bar - entry_bar hold_days, {r4('case when entry * 1.002 - sl > 0 then (exit_price * 0.998 - entry * 1.002) / (entry * 1.002 - sl) else 0 end', 'actual_rr')} from tm2".replace("1.002", "'1.002'::double").replace("0.998", "'0.998'::double"), *CROSS_SIGNALS, TARGETED))
def label_target_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals, rows = _signals(spark, sf_dir)
    return rounded(L.ema_exit(signals, rows, max_hold=40, target_exit=True).select("symbol_id", "signal_bar", "status", "exit_bar", "exit_price", "actual_rr", "hold_days"), "exit_price", "actual_rr")
