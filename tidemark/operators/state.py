"""What a symbol's indicators need of its past, one row a symbol, advanced by a bar at a time.

A live scan reads this table and the new quotes, never the history.  The columns up to `closed`
are as of the last closed bar; `live` is the bar of the day that is still open, whose quotes
replace it until a later day's bar closes it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import trend_class
from .groups import dealt
from .indicators import ATR_PERIOD, CANDLE, EMAS, RSIS, Matrix, ema_step, wilder_step

#: Bars on both sides of a local extreme.
WINDOW = 2
EXTREMES = "array<struct<price:double,confirm_bar:int>>"
BAR = "struct<d:date,open:double,high:double,low:double,close:double,volume:bigint>"
BAR_FIELDS = ("d", "open", "high", "low", "close", "volume")
WILDERS = (f"atr{ATR_PERIOD}", *(f"{kind}{p}" for p in RSIS for kind in ("gain", "loss")))
#: The last so many values before the next bar, oldest first.
RECENT = {"volumes": 20, "closes": 10, "past_ema200": 20, "last_lows": 2 * WINDOW, "last_highs": 2 * WINDOW}
CLOSED = {
    "bar": "int", "close": "double", "total": "double", **{f"ema{p}": "double" for p in EMAS}, **dict.fromkeys(WILDERS, "double"), "volumes": "array<bigint>", "closes": "array<double>", "past_ema200": "array<double>",
    "last_lows": "array<double>", "last_highs": "array<double>", "lows": EXTREMES, "highs": EXTREMES,
}
SCHEMA = "symbol_id bigint, " + ", ".join(f"{n} {t}" for n, t in CLOSED.items()) + f", live {BAR}"


def _period(name: str) -> int:
    return int("".join(c for c in name if c.isdigit()))


def _last(values: pa.ChunkedArray, end: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Of each symbol, whose rows end before `end`, the last so many values."""
    offsets = np.append(0, np.cumsum(sizes))
    at = np.arange(offsets[-1]) + np.repeat(end - offsets[1:], sizes)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(at)).combine_chunks(), type=kind)


def _extremes(values: np.ndarray, place: np.ndarray, bar: np.ndarray, symbols: int, lower: bool, kind: pa.DataType) -> pa.Array:
    """The local lows, or highs, of each symbol by price, with the bar that confirms each; rows are of the symbol at a place, in order of bar."""
    v = values if lower else -values
    inner = np.arange(WINDOW, len(v) - WINDOW)
    hit = place[inner - WINDOW] == place[inner + WINDOW]  # all its neighbours are of the same symbol
    for k in range(1, WINDOW + 1):
        hit &= (v[inner] < v[inner - k]) & (v[inner] < v[inner + k])
    at = inner[hit]
    at = at[np.lexsort((bar[at], values[at], place[at]))]
    items = pa.StructArray.from_arrays([pa.array(values[at]), pa.array(bar[at] + WINDOW, pa.int32())], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(place[at], np.arange(symbols + 1)), pa.int32()), items, type=kind)


def states(rows: pa.Table, kinds: pa.Schema) -> pa.Table:
    """The state of each of some symbols, whose last bar is live: a step takes a bar of all of them, as in Matrix."""
    kind = lambda name: kinds.field(name).type
    rows = rows.sort_by([("symbol_id", "ascending"), ("bar", "ascending")])
    symbol = rows.column("symbol_id").to_numpy()
    live = np.flatnonzero(np.append(symbol[1:] != symbol[:-1], True))
    closed = rows.take(pa.array(np.delete(np.arange(len(symbol)), live)))
    n = np.diff(live, prepend=-1) - 1  # closed bars of each symbol, which may have none
    some, end, place = n > 0, np.cumsum(n), np.repeat(np.arange(len(n)), n)
    bar = np.arange(len(place)) - np.repeat(end - n, n) + 1
    matrix = Matrix(place)
    high, low, close = (matrix.of(closed.column(c).to_numpy()) for c in ("high", "low", "close"))
    before = np.vstack([np.full((1, close.shape[1]), np.nan), close[:-1]]) if len(close) else close

    def of_symbols(values: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
        out = np.zeros(len(n))
        out[some] = values
        return pa.array(out, mask=None if known is None else ~known)

    state = {"symbol_id": pa.array(symbol[live], kind("symbol_id")), "bar": pa.array(n, kind("bar")), "close": of_symbols(closed.column("close").to_numpy()[end[some] - 1], some), "total": of_symbols(matrix.final(close, len(close) + 1))}
    for p in EMAS:
        state[f"ema{p}"] = of_symbols(matrix.final(close, p, ema_step(p)), n >= p)
    change = close - before
    steps = {f"atr{ATR_PERIOD}": np.maximum(np.maximum(high - low, np.abs(high - before)), np.abs(before - low))} | {f"{k}{p}": np.maximum(sign * change, 0.0) for p in RSIS for k, sign in (("gain", 1), ("loss", -1))}
    for name, values in steps.items():
        p = _period(name)
        state[name] = of_symbols(matrix.final(values, p, wilder_step(p), 1))
    past = pa.chunked_array([pa.array(matrix.rows(matrix.smoothed(close, 200, ema_step(200))), from_pandas=True)])
    of = {"volumes": closed.column("volume"), "closes": closed.column("close"), "past_ema200": past, "last_lows": closed.column("low"), "last_highs": closed.column("high")}
    for name, count in RECENT.items():
        state[name] = _last(of[name], end, np.minimum(n, count), kind(name))
    for name, c in (("lows", "low"), ("highs", "high")):
        state[name] = _extremes(closed.column(c).to_numpy(), place, bar, len(n), c == "low", kind(name))
    last = rows.take(pa.array(live))
    state["live"] = pa.StructArray.from_arrays([last.column(f.name).combine_chunks().cast(f.type) for f in kind("live")], fields=list(kind("live")))
    return pa.table([state[name] for name in kinds.names], schema=kinds)


def initial_state(history: DataFrame) -> DataFrame:
    """The state of each symbol, whose last bar may still be open: one shuffle by symbol, once in the life of a scan."""
    rows = dealt(history.select(F.col("symbol_id").cast("long").alias("symbol_id"), *CANDLE))
    kinds = to_arrow_schema(T._parse_datatype_string(SCHEMA))
    return rows.groupBy("_group").applyInArrow(lambda bars: states(bars.drop_columns("_group"), kinds), SCHEMA)


def _kept(values: Column, new: Column, n: int) -> Column:
    longer = F.concat(values, F.array(new))
    return F.when(F.size(longer) > n, F.slice(longer, 2, n)).otherwise(longer)


def _with_extreme(found: Column, last: Column, new: Column, bar: Column, lower: bool) -> Column:
    """found and the extreme, if it is one, of the bar that new confirms, by price."""
    at = F.get(last, F.lit(WINDOW))
    beyond = (lambda x: at < x) if lower else (lambda x: at > x)
    others = [F.get(last, F.lit(k)) for k in range(2 * WINDOW) if k != WINDOW] + [new]
    hit = F.size(last) == 2 * WINDOW
    for x in others:
        hit &= beyond(x)
    return F.when(hit, F.array_sort(F.concat(found, F.array(F.struct(at.alias("price"), bar.cast("int").alias("confirm_bar")))))).otherwise(found)


def advanced(bar: str = "live") -> dict[str, Column]:
    """The columns of CLOSED after the bar in a column of that name, from those before it."""
    b, n = F.col(bar), F.col("bar") + 1
    total, m = F.col("total") + b["close"], F.col("bar")
    out = {"bar": n.cast("int"), "close": b["close"], "total": total}
    for p in EMAS:
        k = 2.0 / (p + 1)
        out[f"ema{p}"] = F.when(n > p, b["close"] * F.lit(k) + F.col(f"ema{p}") * F.lit(1 - k)).when(n == p, total / F.lit(float(p)))
    change = b["close"] - F.col("close")
    steps = {f"atr{ATR_PERIOD}": F.greatest(b["high"] - b["low"], F.abs(b["high"] - F.col("close")), F.abs(F.col("close") - b["low"]))}
    steps |= {f"{kind}{p}": F.greatest(change if kind == "gain" else -change, F.lit(0.0)) for p in RSIS for kind in ("gain", "loss")}
    for name, v in steps.items():
        p, old = float(_period(name)), F.col(name)
        out[name] = F.when(m < 1, old).when(m < p, old + v).when(m == p, (old + v) / F.lit(p)).otherwise((old * F.lit(p - 1) + v) / F.lit(p))
    new = {"volumes": b["volume"], "closes": b["close"], "past_ema200": out["ema200"], "last_lows": b["low"], "last_highs": b["high"]}
    out |= {name: _kept(F.col(name), new[name], size) for name, size in RECENT.items()}
    for name, last, side in (("lows", "last_lows", "low"), ("highs", "last_highs", "high")):
        out[name] = _with_extreme(F.col(name), F.col(last), b[side], n, side == "low")
    return out


def with_live_bars(state: DataFrame, bars: DataFrame) -> DataFrame:
    """state with the live bar of bars (symbol_id, d, open .. volume, opened), which may be the open day's or a later one's, and changed.

    A later day's bar closes the one that was live.  Symbols without a bar, and those that state
    lacks, stay as they are.  A shuffle or a broadcast of the bars; the history has no part in it.
    """
    fresh = bars.select("symbol_id", F.struct(*BAR_FIELDS).cast(BAR).alias("_new"), "opened")
    rows = state.join(fresh, "symbol_id", "left")
    rolls = F.coalesce(F.col("_new.d") > F.col("live.d"), F.lit(False))
    closed = {n: F.when(rolls, c).otherwise(F.col(n)).alias(n) for n, c in advanced().items()}
    return rows.select("symbol_id", *closed.values(), F.coalesce("_new", "live").alias("live"), F.col("_new").isNotNull().alias("changed"), F.coalesce("opened", F.lit(False)).alias("opened"))


def live_features(state: DataFrame) -> DataFrame:
    """What the scans read, as of each symbol's live bar: the candle, its indicators, and lows and highs."""
    after = advanced()
    average = F.coalesce(F.aggregate("volumes", F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("volumes"), F.lit(0)), F.lit(0.0))
    m = F.col("bar")
    rows = state.select(
        "*", average.alias("avg_volume"), F.when(F.size("closes") == RECENT["closes"], F.get("closes", F.lit(0))).alias("close10"), F.when(F.size("past_ema200") == RECENT["past_ema200"], F.get("past_ema200", F.lit(0))).alias("ema200_past"),
        F.when(m >= ATR_PERIOD, F.floor(after[f"atr{ATR_PERIOD}"] * 100 + 0.5) / 100).alias("_atr"), *[after[n].alias(f"_{n}") for n in (*(f"ema{p}" for p in EMAS), "lows", "highs")],
        *[_rsi(after[f"gain{p}"], after[f"loss{p}"], m >= p).alias(f"rsi{p}") for p in RSIS],
    )
    rows = rows.select(
        "symbol_id", "live.d", (m + 1).alias("bar"), *[F.col(f"live.{c}").alias(c) for c in BAR_FIELDS[1:]], *[F.col(f"_ema{p}").alias(f"ema{p}") for p in EMAS], F.col("_atr").alias("atr14"), *[f"rsi{p}" for p in RSIS],
        "avg_volume", F.when(F.col("avg_volume") > 0, F.col("live.volume") / F.col("avg_volume")).otherwise(F.lit(0.0)).alias("volume_ratio"), "close10", "ema200_past", F.col("_lows").alias("lows"), F.col("_highs").alias("highs"), "opened",
    )
    return rows.withColumn("trend", trend_class(F.col("close"), F.col("ema50"), F.col("ema200")))


def _rsi(gain: Column, loss: Column, seeded: Column) -> Column:
    flat = F.when(gain == 0, 50.0).otherwise(100.0)
    return F.when(seeded, F.when(loss == 0, flat).otherwise(100 - 100 / (1 + gain / loss)))
