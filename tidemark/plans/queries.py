"""The registered queries on candles: each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import round4
from ..operators import asof as A
from ..operators import indicators as I
from ..operators import logs, scans
from ..operators import zones as Z
from ..sources import fixtures as fx
from ..sources.shared import shared_path
from ..sources.store import CandleStore
from .oracles import EXT, FEAT, IND, LATEST, r4, sql, zones

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: round4(F.col(c)) for c in columns})


# Stores

OLD_NEW = "old as (select * from candles where d < date '1997-01-01'), new as (select * replace (round(close * 100 + 1) / 100 as close) from candles where d >= date '1996-01-01')"


def _store(spark: SparkSession, sf_dir: str, rows: DataFrame, name: str) -> CandleStore:
    # 2, and more as the symbols grow, so that a month of a bucket stays a file of a fair size
    buckets = max(2, fx.table(spark, sf_dir, "supplier").count() // 5_000)
    store = CandleStore(shared_path(spark, name), buckets=buckets)
    store.create(rows)
    return store


@query(sql("select symbol_id, d, bar, open, high, low, close, volume from candles where symbol_id = 7 and d between date '1995-01-01' and date '1996-12-31' order by d limit 100"))
def candles_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, fx.candles(spark, sf_dir), "candle-range").range(spark, 7, "1995-01-01", "1996-12-31", 100)


@query(sql("select symbol_id, max(d) d, arg_max(close, d) \"close\", arg_max(volume, d) volume from candles group by 1"))
def candles_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.candles(spark, sf_dir).groupBy("symbol_id").agg(F.max("d").alias("d"), F.max_by("close", "d").alias("close"), F.max_by("volume", "d").alias("volume"))


@query(sql("select symbol_id, d, close from old union all select symbol_id, d, close from new n where not exists (select 1 from old o where o.symbol_id = n.symbol_id and o.d = n.d)", OLD_NEW))
def candles_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = fx.batches(fx.candles(spark, sf_dir))
    store = _store(spark, sf_dir, old, "candle-insert")
    store.insert_ignore(new)
    return store.read(spark).select("symbol_id", "d", "close")


@query(sql("select symbol_id, d, close from new union all select symbol_id, d, close from old o where not exists (select 1 from new n where o.symbol_id = n.symbol_id and o.d = n.d)", OLD_NEW))
def candles_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = fx.batches(fx.candles(spark, sf_dir))
    store = _store(spark, sf_dir, old, "candle-upsert")
    store.upsert(new)
    return store.read(spark).select("symbol_id", "d", "close")


@query(sql("select symbol_id, d, close from candles where symbol_id in (select s_suppkey from supplier where s_nationkey = 3)"))
def watchlist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = fx.table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("symbol_id"))
    return fx.candles(spark, sf_dir).select("symbol_id", "d", "close").join(watched, "symbol_id", "left_semi")


# Scalar functions


@query("select s_suppkey symbol_id, upper(trim(regexp_replace(regexp_replace(trim(' nse:' || s_name || '.bo '), '^[^:]*:', ''), '\\..*$', ''))) norm, upper(regexp_replace('nifty ' || s_name, '\\s+', '', 'g')) index_norm from supplier")
def norm_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.table(spark, sf_dir, "supplier")
    raw = F.concat(F.lit(" nse:"), "s_name", F.lit(".bo "))
    return s.select(F.col("s_suppkey").alias("symbol_id"), S.norm_symbol(raw).alias("norm"), S.index_symbol(F.concat(F.lit("nifty "), "s_name")).alias("index_norm"))


@query(sql("select symbol_id, d, round((close / 3) * 100) / 100 third, round((close * 1.005::double) * 100) / 100 raised from candles"))
def round2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.candles(spark, sf_dir).select("symbol_id", "d", S.round2(F.col("close") / 3).alias("third"), S.round2(F.col("close") * F.lit(1.005)).alias("raised"))


@query(sql(f"select symbol_id, d, {r4('case when open > 0 then (close - open) / open * 100 else 0 end', 'pct')}, case when high > low then {r4('(close - low) / (high - low)', 'strength')} end strength from candles").replace(" strength end strength", " end strength"))
def pct_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.candles(spark, sf_dir).select("symbol_id", "d", round4(S.pct_from(F.col("close"), F.col("open"))).alias("pct"), round4(S.close_strength(F.col("high"), F.col("low"), F.col("close"))).alias("strength"))


@query(sql("select symbol_id, d, case when high > low then round(((close - low) / (high - low)) * 10000) / 10000 end strength from candles where high > low"))
def close_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.candles(spark, sf_dir).filter("high > low").select("symbol_id", "d", round4(S.close_strength(F.col("high"), F.col("low"), F.col("close"))).alias("strength"))


@query(sql("select trend, count(*)::bigint n from feat group by 1", IND, FEAT))
def trend_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.indicators(fx.candles(spark, sf_dir), "ema50", "ema200")
    return rows.withColumn("trend", S.trend_class(F.col("close"), F.col("ema50"), F.col("ema200"))).groupBy("trend").agg(F.count("*").alias("n"))


@query(sql("select case when rr >= 3 then 'excellent' when rr >= 2 then 'good' when rr >= 1.5 then 'fair' else 'poor' end grade, count(*)::bigint n from (select round((high - close) / (close - low) * 100) / 100 rr from candles where close > low) group by 1"))
def rr_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = S.round2((F.col("high") - F.col("close")) / (F.col("close") - F.col("low")))
    return fx.candles(spark, sf_dir).filter("close > low").select(S.rr_grade(rr).alias("grade")).groupBy("grade").agg(F.count("*").alias("n"))


@query(sql("select symbol_id, d, round(open * '1.002'::double * 10000) / 10000 bought, round(close * '0.998'::double * 10000) / 10000 sold, round(((close * '0.998'::double * '0.99875'::double / (open * '1.002'::double * '1.00125'::double) - 1) * 100) * 10000) / 10000 net_pct from candles"))
def fill_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.candles(spark, sf_dir)
    return rows.select("symbol_id", "d", round4(S.buy_fill(F.col("open"), 0.002)).alias("bought"), round4(S.sell_fill(F.col("close"), 0.002)).alias("sold"), round4(S.net_pct(F.col("open"), F.col("close"))).alias("net_pct"))


@query(sql("select symbol_id, d, case when (close - low) / close > 0 then round(least(1e6::double * '0.01'::double / ((close - low) / close), 1e6::double * '0.2'::double, 150000::double) * 100) / 100 else 0 end sized, round(least(1e6::double / 5::double, 150000::double) * 100) / 100 equal_slice from candles"))
def position_notional(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (F.lit(1e6), F.lit(150000.0), F.col("close"), F.col("low"))
    return fx.candles(spark, sf_dir).select("symbol_id", "d", S.round2(S.position_notional(*args, 1.0, 20.0, 5)).alias("sized"), S.round2(S.position_notional(*args, 0.0, 20.0, 5)).alias("equal_slice"))


LOCAL = "l as (select event_id, ts + interval '5 hours 30 minutes' t from events), m as (select event_id, t, isodow(t) < 6 weekday, extract(hour from t) * 60 + extract(minute from t) + floor(extract(second from t)) / 60.0::double mi from l), o as (select *, weekday and mi >= 555 and mi <= 930 is_open from m)"


@query(f"with {LOCAL} select is_open, count(*)::bigint n from o group by 1")
def market_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return fx.table(spark, sf_dir, "events").select(S.market_open(ts).alias("is_open")).groupBy("is_open").agg(F.count("*").alias("n"))


@query(f"with {LOCAL} select event_id, round((case when is_open then greatest(mi - 555, 30) / 375 else 1 end) * 10000) / 10000 share from o")
def session_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", round4(S.session_fraction(F.col("ts").cast("timestamp"))).alias("share"))


@query(sql("select distinct d, (d - interval 2 year)::date y2, (d - interval 6 month)::date m6, (d - interval 90 day)::date d90 from candles"))
def period_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return fx.candles(spark, sf_dir).select("d").distinct().select("d", S.period_start("2y", d).alias("y2"), S.period_start("6m", d).alias("m6"), S.period_start("90d", d).alias("d90"))


# Indicators


def _ind(spark: SparkSession, sf_dir: str, *values: str) -> DataFrame:
    return I.indicators(fx.candles(spark, sf_dir), *values)


def _bars(spark: SparkSession, sf_dir: str, strategy: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    return scans.bar_features(fx.candles(spark, sf_dir), strategy=strategy, more=more)


def _feat(spark: SparkSession, sf_dir: str, last_only: bool = False, strategy: str | None = None, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    return scans.features(fx.candles(spark, sf_dir), last_only=last_only, strategy=strategy, more=more)


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of fresh crossings, with the extremes of their symbol."""
    rows, extremes = _crossings(spark, sf_dir)
    return rows.join(extremes, "symbol_id")


def _crossings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, extremes = _feat(spark, sf_dir, strategy="crossover", more=("cross",))
    return rows.filter("cross and bar >= 50"), extremes


@query(sql(f"select symbol_id, bar, {r4('ema7')}, {r4('ema21')}, {r4('ema50')}, {r4('ema200')} from ind", IND))
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ind(spark, sf_dir, "ema7", "ema21", "ema50", "ema200").select("symbol_id", "bar", "ema7", "ema21", "ema50", "ema200"), "ema7", "ema21", "ema50", "ema200")


@query(sql(f"select symbol_id, bar, {r4('ema10')}, {r4('ema50')}, {r4('ema200')} from ind join ({LATEST}) using (symbol_id, bar)", IND))
def ema_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.latest(_ind(spark, sf_dir, "ema10", "ema50", "ema200")).select("symbol_id", "bar", "ema10", "ema50", "ema200"), "ema10", "ema50", "ema200")


@query(sql(f"select symbol_id, bar, {r4('true_range')} from (select *, case when bar > 1 then greatest(high - low, abs(high - lag(close) over w), abs(lag(close) over w - low)) end true_range from candles window w as (partition by symbol_id order by bar))"))
def true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ind(spark, sf_dir, "true_range").select("symbol_id", "bar", "true_range"), "true_range")


@query(sql("select symbol_id, bar, atr14 from ind", IND))
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ind(spark, sf_dir, "atr14").select("symbol_id", "bar", "atr14")


@query(sql(f"select symbol_id, bar, {r4('rsi2')}, {r4('rsi14')} from ind", IND))
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ind(spark, sf_dir, "rsi2", "rsi14").select("symbol_id", "bar", "rsi2", "rsi14"), "rsi2", "rsi14")


@query(sql(f"select symbol_id, bar, {r4('avg_volume')}, {r4('case when avg_volume > 0 then volume / avg_volume else 0 end', 'volume_ratio')} from (select *, coalesce(avg(volume) over (partition by symbol_id order by bar rows between 20 preceding and 1 preceding), 0) avg_volume from candles)"))
def volume_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.volume_stats(fx.candles(spark, sf_dir)).select("symbol_id", "bar", "avg_volume", "volume_ratio"), "avg_volume", "volume_ratio")


@query(sql(f"select symbol_id, bar, {r4('(close - ema10) / ema10 * 100', 'ext_ema10')}, {r4('(close - ema50) / ema50 * 100', 'ext_ema50')}, {r4('(close - close10) / close10 * 100', 'move10')} from feat where bar >= 50", IND, FEAT))
def extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ind(spark, sf_dir, "ema10", "ema50").withColumn("close10", F.lag("close", 10).over(I.by_bar())).filter("bar >= 50")
    c = F.col("close")
    return rows.select("symbol_id", "bar", round4(S.pct_from(c, F.col("ema10"))).alias("ext_ema10"), round4(S.pct_from(c, F.col("ema50"))).alias("ext_ema50"), round4(S.pct_from(c, F.col("close10"))).alias("move10"))


@query(sql("select symbol_id, bar, ema200 >= ema200_past rising from feat where bar >= 220", IND, FEAT))
def ema200_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ind(spark, sf_dir, "ema200").withColumn("past", F.lag("ema200", 20).over(I.by_bar())).filter("bar >= 220")
    return rows.select("symbol_id", "bar", (F.col("ema200") >= F.col("past")).alias("rising"))


@query(sql(f"select symbol_id, bar, {r4('(close - b) / b * 100', 'ret')} from (select *, lag(close, 20) over (partition by symbol_id order by bar) b from candles)"))
def ret_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.with_return(fx.candles(spark, sf_dir), 20, "symbol_id", order="bar").select("symbol_id", "bar", "ret"), "ret")


@query(sql("select symbol_id, bar, cross_bar, bar - cross_bar cross_age from feat where cross_bar is not null", IND, FEAT))
def ema_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.crossings(_ind(spark, sf_dir, "ema7", "ema21")).filter("cross_bar is not null").select("symbol_id", "bar", "cross_bar", "cross_age")


@query(sql(f"select symbol_id, bar, {r4('v / a', 'cross_volume_ratio')} from (select *, arg_max(volume, bar) filter (is_cross) over w v, arg_max(avg_volume, bar) filter (is_cross) over w a from feat window w as (partition by symbol_id order by bar rows between 2 preceding and current row)) where cross_bar is not null and a > 0", IND, FEAT))
def cross_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bars(spark, sf_dir).filter("cross_bar is not null and crossed.avg_volume > 0")
    return rows.select("symbol_id", "bar", round4(F.col("crossed.volume") / F.col("crossed.avg_volume")).alias("cross_volume_ratio"))


@query(sql("select symbol_id, bar, volume >= 1.5::double * a surge from (select *, avg(volume) over (partition by symbol_id order by bar rows between 10 preceding and 1 preceding) a from candles) where a is not null"))
def volume_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.candles(spark, sf_dir).withColumn("a", F.avg("volume").over(I.by_bar().rowsBetween(-10, -1))).filter("a is not null")
    return rows.select("symbol_id", "bar", (F.col("volume") >= F.lit(1.5) * F.col("a")).alias("surge"))


@query(sql("select symbol_id, kind, price, confirm_bar from ext", EXT))
def local_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.extrema(fx.candles(spark, sf_dir))
    found = [F.when(F.col(f"is_{k}"), F.struct(F.lit(k).alias("kind"), F.col(k).alias("price"), "confirm_bar")) for k in ("low", "high")]
    return rows.select("symbol_id", F.inline(F.array_compact(F.array(*found))))


@query(sql(f"select symbol_id, bar, {r4('coalesce(close / b - 1, 0)', 'leadership')} from (select *, lag(close, 50) over (partition by symbol_id order by bar) b from candles)"))
def leadership_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.candles(spark, sf_dir).withColumn("b", F.lag("close", 50).over(I.by_bar()))
    return rows.select("symbol_id", "bar", round4(F.coalesce(F.col("close") / F.col("b") - 1, F.lit(0.0))).alias("leadership"))


@query(sql("select symbol_id, arg_max(close, d) prev_close from candles where d < (select max(d) from candles) group by 1"))
def prev_session_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.candles(spark, sf_dir)
    today = F.broadcast(rows.agg(F.max("d").alias("today")))
    return rows.join(today, F.col("d") < F.col("today")).groupBy("symbol_id").agg(F.max_by("close", "d").alias("prev_close"))


BENCH = "bench as materialized (select d, row_number() over (order by d) bar, round(sum(round(close * 100)::bigint)::bigint / count(*)) / 100 as close from candles group by 1)"
BREC = "brec as (select *, close total, null::double e50, null::double e200 from bench where bar = 1 union all select c.*, r.total + c.close, " + ", ".join(f"case when c.bar > {p} then c.close * ('{2.0 / (p + 1)!r}'::double) + r.e{p} * ('{1 - 2.0 / (p + 1)!r}'::double) when c.bar = {p} then (r.total + c.close) / {p}::double end" for p in (50, 200)) + " from brec r join bench c on c.bar = r.bar + 1)"


def _bench_ind(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = fx.bench_index(fx.candles(spark, sf_dir))
    rows = bench.select(F.lit(0).alias("symbol_id"), "d", F.row_number().over(W.orderBy("d")).alias("bar"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(0).cast("long").alias("volume"))
    return I.indicators(rows, "ema50", "ema200")


@query(sql("select d, coalesce(close > e200, true) price_open, case when e200 is null then true else e50 > e200 end ema_open from brec", BENCH, BREC))
def regime_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bench_ind(spark, sf_dir)
    return rows.select("d", F.coalesce(F.col("close") > F.col("ema200"), F.lit(True)).alias("price_open"), F.coalesce(F.col("ema50") > F.col("ema200"), F.lit(True)).alias("ema_open"))


# Zones


def _at_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Z.latest_with_extremes(I.extrema(fx.candles(spark, sf_dir)))
    return rows.select("symbol_id", "bar", "close", F.inline(Z.zones_of_both(F.col("bar"))))


@query(sql("select symbol_id, bar, kind, low, high, mid, touches from zones", EXT, zones(LATEST)))
def zones_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at_latest(spark, sf_dir).drop("close")


@query(sql("select *, row_number() over (partition by symbol_id, kind order by touches desc, high - low, low)::int rank from (select symbol_id, kind, low, high, touches from zones where kind = 'low' or touches >= 2)", EXT, zones(LATEST)))
def zones_filter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _at_latest(spark, sf_dir).filter("kind = 'low' or touches >= 2")
    rank = F.row_number().over(W.partitionBy("symbol_id", "kind").orderBy(F.desc("touches"), F.col("high") - F.col("low"), "low"))
    return rows.select("symbol_id", "kind", "low", "high", "touches", rank.alias("rank"))


@query(sql("select c.symbol_id, (select max(mid) from zones z where z.symbol_id = c.symbol_id and kind = 'low' and z.high < c.close) support_mid, (select min(mid) from zones z where z.symbol_id = c.symbol_id and kind = 'high' and touches >= 2 and z.low > c.close) resistance_mid, (select min(mid) from zones z where z.symbol_id = c.symbol_id and kind = 'high' and z.low > c.close and mid >= c.close * '1.04'::double) target_mid from candles c join (" + LATEST + ") using (symbol_id, bar)", EXT, zones(LATEST)))
def nearest_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Z.latest_with_extremes(I.extrema(fx.candles(spark, sf_dir)))
    lows, highs, price = Z.zones_asof("lows", F.col("bar")), Z.zones_asof("highs", F.col("bar")), F.col("close")
    return rows.select("symbol_id", Z.nearest_below(lows, price)["mid"].alias("support_mid"), Z.nearest_above(highs, price)["mid"].alias("resistance_mid"), Z.nearest_above(highs, price, 1, price * F.lit(1.04))["mid"].alias("target_mid"))


CROSSED = "select symbol_id, bar from feat where is_cross and bar >= 50"


@query(sql("select symbol_id, bar, min(mid) target_mid from zones z join feat f using (symbol_id, bar) where kind = 'high' and z.low > f.close and mid >= f.close * '1.04'::double group by 1, 2", IND, FEAT, EXT, zones(CROSSED)))
def target_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _crossed(spark, sf_dir)
    target = Z.nearest_above(Z.zones_asof("highs", F.col("bar")), F.col("close"), 1, F.col("close") * F.lit(1.04))["mid"]
    return rows.select("symbol_id", "bar", target.alias("target_mid")).filter("target_mid is not null")


@query(sql("select symbol_id, side, rank, low, high, mid, touches from (select z.*, case when mid > c.close then 'above' else 'below' end side, row_number() over (partition by z.symbol_id, mid > c.close order by abs(mid - c.close), mid, kind, z.low, z.high, touches)::int rank from zones z join candles c using (symbol_id, bar))", EXT, zones(LATEST)))
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All zones at the last bar, those above its close and those below, the nearest first."""
    rows = _at_latest(spark, sf_dir).withColumn("side", F.when(F.col("mid") > F.col("close"), "above").otherwise("below"))
    rank = F.row_number().over(W.partitionBy("symbol_id", "side").orderBy(F.abs(F.col("mid") - F.col("close")), "mid", "kind", "low", "high", "touches"))
    return rows.withColumn("rank", rank).select("symbol_id", "side", "rank", "low", "high", "mid", "touches")


RECENT = "rcand as (select symbol_id, bar from candles join (select symbol_id, max(bar) lb from candles group by 1) using (symbol_id) where bar > lb - 120), ext as materialized (select e.* from ext0 e join rcand r on r.symbol_id = e.symbol_id and r.bar = e.confirm_bar - 2)"


@query(sql("select symbol_id, kind, low, high, mid, touches from zones", EXT.replace("ext as materialized", "ext0 as materialized"), RECENT, zones(LATEST)))
def levels_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones at the last bar, of the extremes of the last 120 bars."""
    rows = Z.latest_with_extremes(I.extrema(fx.candles(spark, sf_dir)), 120)
    return rows.select("symbol_id", F.inline(Z.zones_of_both(F.col("bar"))))


@query(sql("select symbol_id, bar, kind, count(*)::bigint n, sum(touches)::bigint touches, min(low) lowest, max(high) highest from zones group by all", IND, FEAT, EXT, zones(CROSSED)))
def zones_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.counted(*_crossings(spark, sf_dir))


# Joins

RET = "sret as (select symbol_id, d, bar, (close - lag(close, 20) over w) / lag(close, 20) over w * 100 stock_ret from candles window w as (partition by symbol_id order by bar)), bret as (select d, (close - lag(close, 20) over (order by d)) / lag(close, 20) over (order by d) * 100 bench_ret from bench)"


@query(sql(f"select symbol_id, bar, {r4('stock_ret')}, {r4('bench_ret')}, {r4('stock_ret - bench_ret', 'outperformance')} from sret s asof left join bret b on s.d >= b.d", BENCH, RET))
def relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.candles(spark, sf_dir)
    out = A.relative_strength(rows, fx.bench_index(rows)).select("symbol_id", "bar", "stock_ret", "bench_ret", "outperformance")
    return rounded(out, "stock_ret", "bench_ret", "outperformance")


SECTOR = "smap as (select s_suppkey symbol_id, n_regionkey::int sector from supplier join nation on s_nationkey = n_nationkey), sidx as (select sector, d, round(sum(round(close * 100)::bigint)::bigint / count(*)) / 100 as close from candles join smap using (symbol_id) where isodow(d) < 6 group by 1, 2), xret as (select sector, d, (close - lag(close, 20) over w) / lag(close, 20) over w * 100 stock_ret from sidx window w as (partition by sector order by d))"


@query(sql(f"select c.symbol_id, c.bar, m.sector, {r4('x.stock_ret', 'stock_ret')}, {r4('b.bench_ret', 'bench_ret')}, {r4('x.stock_ret - b.bench_ret', 'outperformance')} from (select c.*, sector from candles c join smap using (symbol_id)) c join smap m using (symbol_id) asof left join xret x on x.sector = c.sector and c.d >= x.d asof left join bret b on c.d >= b.d", BENCH, RET, SECTOR))
def sector_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sectors = fx.candles(spark, sf_dir), fx.sector_map(spark, sf_dir)
    out = A.sector_strength(rows, sectors, fx.sector_index(rows, sectors), fx.bench_index(rows)).select("symbol_id", "bar", "sector", "stock_ret", "bench_ret", "outperformance")
    return rounded(out, "stock_ret", "bench_ret", "outperformance")


@query(sql("select symbol_id, d, min(n.d2) next_d from (select distinct symbol_id, (d - interval 1 day)::date d from candles) s asof join (select symbol_id sid, d d2 from candles) n on sid = symbol_id and d2 > d group by 1, 2"))
def next_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.candles(spark, sf_dir)
    asked = rows.select("symbol_id", F.date_sub("d", 1).alias("d"), F.lit(1).alias("asked")).distinct()
    both = asked.unionByName(rows.select("symbol_id", "d", F.lit(0).alias("asked")))
    # from the last day back, so that the frame only grows: one that ends at the last row is added up anew for each row
    later = F.min(F.when(F.col("asked") == 0, F.col("d"))).over(W.partitionBy("symbol_id").orderBy(F.unix_date("d").desc()).rangeBetween(W.unboundedPreceding, -1))
    return both.withColumn("next_d", later).filter("asked = 1 and next_d is not null").select("symbol_id", "d", "next_d")
