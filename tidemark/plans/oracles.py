"""DuckDB SQL for the registered queries, composed of common table expressions."""

from __future__ import annotations

from ..operators.indicators import EMAS

CANDLES = """candles as materialized (
  with d as (select l_suppkey symbol_id, cast(l_shipdate as date) d, sum(cast(round(l_discount * 100) as int) - 5)::bigint disc_pts,
                    sum(cast(round(l_tax * 100) as int) - 4)::bigint tax_pts, cast(sum(l_quantity) as bigint) qty from lineitem group by 1, 2),
  c as (select *, (sum(disc_pts) over (partition by symbol_id order by d rows unbounded preceding))::bigint cum, row_number() over (partition by symbol_id order by d) bar from d),
  p as (select symbol_id, d, bar, qty, round(10000 * exp((60 * cum + 4 * bar) / cast(10000 as double))) / 100 as close,
               round(10000 * exp((60 * (cum - disc_pts) + 4 * (bar - 1) + 5 * tax_pts) / cast(10000 as double))) / 100 as open from c)
  select symbol_id, d, bar::int bar, open, round(greatest(open, close) * (10000 + 2 * (qty % 50)) / cast(100 as double)) / 100 as high,
         round(least(open, close) * (10000 - 2 * ((qty * 7) % 50)) / cast(100 as double)) / 100 as low, close, qty * 1000 as volume from p)"""


def dbl(x: float) -> str:
    return f"({x!r})::double" if "e" in repr(x) else f"'{x!r}'::double"


def _ema(p: int) -> str:
    k = 2.0 / (p + 1)
    return f"case when c.bar > {p} then c.close * {dbl(k)} + r.ema{p} * {dbl(1 - k)} when c.bar = {p} then (r.total + c.close) / {p}::double end"


def _wilder(old: str, value: str, p: int) -> str:
    return f"case when c.bar <= {p} then r.{old} + {value} when c.bar = {p + 1} then (r.{old} + {value}) / {p}::double else (r.{old} * {p - 1}::double + {value}) / {p}::double end"


_GAIN, _LOSS = "case when c.close - r.close >= 0 then c.close - r.close else 0 end", "case when c.close - r.close < 0 then r.close - c.close else 0 end"
_TR = "greatest(c.high - c.low, abs(c.high - r.close), abs(r.close - c.low))"

IND = f"""rec as (
  select *, close total, null::double true_range, {", ".join(f"null::double ema{p}" for p in EMAS)}, 0::double atr, 0::double gain2, 0::double loss2, 0::double gain14, 0::double loss14 from candles where bar = 1
  union all
  select c.*, r.total + c.close, {_TR}, {", ".join(_ema(p) for p in EMAS)}, {_wilder("atr", _TR, 14)},
         {_wilder("gain2", _GAIN, 2)}, {_wilder("loss2", _LOSS, 2)}, {_wilder("gain14", _GAIN, 14)}, {_wilder("loss14", _LOSS, 14)}
  from rec r join candles c on c.symbol_id = r.symbol_id and c.bar = r.bar + 1),
ind as materialized (select symbol_id, d, bar, open, high, low, close, volume, {", ".join(f"ema{p}" for p in EMAS)}, true_range, case when bar > 14 then round(atr * 100) / 100 end atr14,
  {", ".join(f"case when bar > {p} then case when loss{p} = 0 then case when gain{p} = 0 then 50 else 100 end else 100 - 100 / (1 + gain{p} / loss{p}) end end rsi{p}" for p in (2, 14))} from rec)"""

FEAT = """f0 as (select *, coalesce(avg(volume) over w20, 0) avg_volume, lag(ema7) over w p7, lag(ema21) over w p21, lag(low) over w prior_low, lag(ema200, 20) over w ema200_past,
    lag(close, 10) over w close10, lead(open) over w next_open, lead(close) over w next_close, lead(d) over w next_d,
    case when close > ema50 and close > ema200 then 'bullish' when close < ema50 and close < ema200 then 'bearish' else 'neutral' end trend
  from ind window w as (partition by symbol_id order by bar), w20 as (partition by symbol_id order by bar rows between 20 preceding and 1 preceding)),
f1 as (select *, case when avg_volume > 0 then volume / avg_volume else 0 end volume_ratio, coalesce(bar >= 22 and ema7 > ema21 and p7 <= p21, false) is_cross from f0),
feat as materialized (select *, case when ema7 > ema21 then max(case when is_cross then bar end) over (partition by symbol_id order by bar rows between 2 preceding and current row) end cross_bar,
    max(bar) over (partition by symbol_id) last_bar from f1)"""

EXT = """ex0 as (select symbol_id, bar, low, high,
    count(*) over b = 2 and count(*) over a = 2 and min(low) over b > low and min(low) over a > low is_low,
    count(*) over b = 2 and count(*) over a = 2 and max(high) over b < high and max(high) over a < high is_high
  from candles window b as (partition by symbol_id order by bar rows between 2 preceding and 1 preceding), a as (partition by symbol_id order by bar rows between 1 following and 2 following)),
ext as materialized (select symbol_id, 'low' kind, low price, bar + 2 confirm_bar from ex0 where is_low union all select symbol_id, 'high', high, bar + 2 from ex0 where is_high)"""


def zones(candidates: str) -> str:
    """Zones as of the (symbol_id, bar) of a query."""
    return f"""cand as materialized ({candidates}),
zp as materialized (select c.symbol_id, c.bar, e.kind, e.price, row_number() over (partition by c.symbol_id, c.bar, e.kind order by e.price) rn from cand c join ext e on e.symbol_id = c.symbol_id and e.confirm_bar <= c.bar),
zr as (select symbol_id, bar, kind, rn, price, price lo, 1 zid from zp where rn = 1
  union all select p.symbol_id, p.bar, p.kind, p.rn, p.price, case when (p.price - (r.lo + r.price) / 2) / ((r.lo + r.price) / 2) <= 0.02::double then r.lo else p.price end,
    case when (p.price - (r.lo + r.price) / 2) / ((r.lo + r.price) / 2) <= 0.02::double then r.zid else r.zid + 1 end
  from zr r join zp p on p.symbol_id = r.symbol_id and p.bar = r.bar and p.kind = r.kind and p.rn = r.rn + 1),
zones as materialized (select symbol_id, bar, kind, zid, min(price) low, max(price) high, (min(price) + max(price)) / 2 mid, count(*)::int touches from zr group by all)"""


LATEST = "select symbol_id, max(bar) bar from candles group by 1"
R4 = "round({0} * 10000) / 10000"


def r4(e: str, name: str | None = None) -> str:
    return f"round(({e}) * 10000) / 10000 {name or e}"


def sql(select: str, *parts: str) -> str:
    return "with recursive " + ",\n".join([CANDLES, *parts]) + "\n" + select
