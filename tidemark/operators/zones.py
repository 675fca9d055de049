"""Price levels: clusters of local extremes, as they were known at each bar."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import per_group_of_both, per_symbol_of_both

ZONE = "struct<low:double,high:double,mid:double,touches:int>"


def cluster(prices: Column, pct: float = 0.02) -> Column:
    """Zones of an ascending array of prices: a price joins while it is within pct of the middle, which moves as the zone grows."""
    mid = lambda a: (a["low"] + a["high"]) / 2
    zone = lambda a: F.array(F.struct(a["low"].alias("low"), a["high"].alias("high"), mid(a).alias("mid"), a["touches"].alias("touches")))
    null = F.lit(None).cast("double")
    start = F.struct(null.alias("low"), null.alias("high"), F.lit(0).alias("touches"), F.array().cast(f"array<{ZONE}>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        near = (a["touches"] > 0) & (mid(a) > 0) & ((p - mid(a)) / mid(a) <= pct)
        grown = F.struct(a["low"].alias("low"), p.alias("high"), (a["touches"] + 1).alias("touches"), a["out"].alias("out"))
        begun = F.struct(p.alias("low"), p.alias("high"), F.lit(1).alias("touches"), F.when(a["touches"] > 0, F.concat(a["out"], zone(a))).otherwise(a["out"]).alias("out"))
        return F.when(near, grown).otherwise(begun)

    return F.aggregate(prices, start, step, lambda a: F.when(a["touches"] > 0, F.concat(a["out"], zone(a))).otherwise(a["out"]))


def extremes_of(rows: DataFrame) -> DataFrame:
    """(symbol_id, lows, highs): a symbol's local lows and highs, (price, confirm_bar) each, ascending by price."""

    def known(flag: str, price: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col(flag), F.struct(F.col(price).alias("price"), "confirm_bar")))).alias(f"{price}s")

    return rows.groupBy("symbol_id").agg(known("is_low", "low"), known("is_high", "high"))


class Levels:
    """The zones of a growing set of prices, as cluster makes them of all, in order."""

    def __init__(self, pct: float = 0.02):
        self.pct = pct
        self.zones: list[list[float]] = []  # the prices of each, ascending
        self.lows: list[float] = []
        self.highs: list[float] = []

    def near(self, zone: list[float], price: float) -> bool:
        mid = (zone[0] + zone[-1]) / 2
        return mid > 0 and (price - mid) / mid <= self.pct

    def add(self, price: float) -> None:
        """Zones before the price's stay; from there on prices are dealt anew, until a zone begins where one did."""
        first = max(0, bisect_right(self.lows, price) - 1)
        new: list[list[float]] = []
        at, waiting = first, True
        while at < len(self.zones) or waiting:
            prices = list(self.zones[at]) if at < len(self.zones) else []
            if waiting:
                insort(prices, price)
                waiting = False
            elif not self.near(new[-1], prices[0]):
                break
            at += 1
            for p in prices:
                if new and self.near(new[-1], p):
                    new[-1].append(p)
                else:
                    new.append([p])
        self.zones[first:at], self.lows[first:at], self.highs[first:at] = new, [z[0] for z in new], [z[-1] for z in new]

    def extend(self, prices: list[float]) -> None:
        """As add of each; all prices are dealt anew where that is less work."""
        if len(prices) * 8 < sum(map(len, self.zones)):
            for p in prices:
                self.add(p)
            return
        zones: list[list[float]] = []
        for p in sorted([p for zone in self.zones for p in zone] + prices):
            if zones and self.near(zones[-1], p):
                zones[-1].append(p)
            else:
                zones.append([p])
        self.zones, self.lows, self.highs = zones, [z[0] for z in zones], [z[-1] for z in zones]

    def _zone(self, k: int) -> dict[str, float]:
        low, high = self.lows[k], self.highs[k]
        return {"mid": (low + high) / 2, "low": low, "high": high, "touches": len(self.zones[k])}

    def below(self, price: float) -> dict[str, float] | None:
        """The highest zone whose high is below price."""
        k = bisect_left(self.highs, price) - 1
        return self._zone(k) if k >= 0 else None

    def above(self, price: float, min_touches: int, min_mid: float | None) -> dict[str, float] | None:
        """The lowest zone whose low is above price, of min_touches prices, and from min_mid on."""
        for k in range(bisect_right(self.lows, price), len(self.lows)):
            if len(self.zones[k]) >= min_touches and (min_mid is None or (self.lows[k] + self.highs[k]) / 2 >= min_mid):
                return self._zone(k)
        return None


def _by_confirm(extremes: pa.ChunkedArray) -> tuple[list[int], list[int], list[float]]:
    """Where each symbol's extremes begin, and all of them, a symbol's in order of the bar that confirms them: (offsets, bars, prices)."""
    lists = extremes.combine_chunks()
    items, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    bars, prices = (pc.struct_field(items, c).to_numpy(zero_copy_only=False) for c in ("confirm_bar", "price"))
    order = np.lexsort((prices, bars, np.repeat(np.arange(len(sizes)), sizes)))
    return [0, *np.cumsum(sizes).tolist()], bars[order].tolist(), prices[order].tolist()


class _Growing:
    """The levels of the extremes of _by_confirm at a place, bar by bar; none without a place."""

    def __init__(self, extremes: tuple[list[int], list[int], list[float]], place: int | None):
        offsets, self.bars, self.prices = extremes
        self.next, self.end = (0, 0) if place is None else (offsets[place], offsets[place + 1])
        self.levels = Levels()

    def at(self, bar: int) -> Levels:
        if self.next < self.end and self.bars[self.next] <= bar:
            due = bisect_right(self.bars, bar, self.next, self.end)
            self.levels.extend(self.prices[self.next : due])
            self.next = due
        return self.levels


NEAREST = "struct<mid:double,low:double,high:double,touches:int>"


def with_nearest(rows: DataFrame, extremes: DataFrame, wanted: Column, min_touches: int = 2, min_mid_pct: float | None = None) -> DataFrame:
    """rows with support and resistance, where they are wanted: the nearest zones below and above the close, as known at the bar.

    extremes are those of extremes_of.  Resistance has min_touches prices and a middle at least
    min_mid_pct above the close.  A symbol's extremes come into its zones in order of the bar that
    confirms them, and change but the zones that they touch, so a pass over a symbol's bars is
    all that its history costs; bars for which no zone is wanted don't take part.
    """
    kind = pa.struct([("mid", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("touches", pa.int32())])

    def walk(bars: pa.Table, known: pa.Table) -> pa.Table:
        bars = bars.sort_by([("symbol_id", "ascending"), ("bar", "ascending")])
        places = {symbol: k for k, symbol in enumerate(known.column("symbol_id").to_pylist())}
        lows, highs = (_by_confirm(known.column(name)) for name in ("lows", "highs"))
        supports, resistances, now = [], [], None
        for symbol, bar, price in zip(*(bars.column(c).to_pylist() for c in ("symbol_id", "bar", "close"))):
            if symbol != now:
                now, place = symbol, places.get(symbol)
                below, above = _Growing(lows, place), _Growing(highs, place)
            supports.append(below.at(bar).below(price))
            resistances.append(above.at(bar).above(price, min_touches, None if min_mid_pct is None else price * (1 + min_mid_pct / 100)))
        return bars.append_column("support", pa.array(supports, kind)).append_column("resistance", pa.array(resistances, kind))

    rows = rows.drop("support", "resistance")
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"support {NEAREST}, resistance {NEAREST}").fields])
    chosen = per_group_of_both(rows.filter(wanted), extremes.select("symbol_id", "lows", "highs"), walk, schema)
    return chosen.unionByName(rows.filter(~wanted), allowMissingColumns=True)


def latest_with_extremes(rows: DataFrame, last_bars: int | None = None) -> DataFrame:
    """The last bar of each symbol with the symbol's extremes, of its last bars only if so asked; rows have is_low and is_high."""
    kept = rows.withColumn("_last", F.max("bar").over(W.partitionBy("symbol_id"))).filter(F.col("bar") > F.col("_last") - last_bars) if last_bars else rows
    known = lambda flag, price: F.array_sort(F.collect_list(F.when(F.col(flag), F.struct(F.col(price).alias("price"), "confirm_bar")))).alias(f"{price}s")
    return kept.groupBy("symbol_id").agg(F.max("bar").alias("bar"), F.max_by("close", "bar").alias("close"), known("is_low", "low"), known("is_high", "high"))


def zones_asof(extremes: str, bar: Column) -> Column:
    """Zones of the extremes that are confirmed at a bar."""
    return cluster(F.transform(F.filter(extremes, lambda x: x["confirm_bar"] <= bar), lambda x: x["price"]))


def zones_of_both(bar: Column) -> Column:
    """Zones of the columns lows and highs that are confirmed at a bar, each with its kind: one array, so that one pass makes both."""

    def of(kind: str) -> Column:
        return F.transform(zones_asof(f"{kind}s", bar), lambda z: F.struct(F.lit(kind).alias("kind"), *[z[c].alias(c) for c in ("low", "high", "mid", "touches")]))

    return F.concat(of("low"), of("high"))


COUNTED = "symbol_id bigint, bar int, kind string, n bigint, touches bigint, lowest double, highest double"


def counted(rows: DataFrame, extremes: DataFrame) -> DataFrame:
    """COUNTED of rows' bars: how many zones of each kind were known at the bar, with their touches and bounds; none has no row.

    As in with_nearest extremes come into a symbol's zones one by one, so no bar builds them anew.
    """

    def walk(bars: pa.Table, known: pa.Table) -> pa.Table:
        columns: dict[str, list] = {c.split()[0]: [] for c in COUNTED.split(", ")}
        numbers, symbols = bars.column("bar").to_pylist(), bars.column("symbol_id").to_pylist()
        for kind in ("low", "high"):
            found = known.column(f"{kind}s")[0].as_py() if known.num_rows else None
            levels, due, at = Levels(), sorted((x["confirm_bar"], x["price"]) for x in found or ()), 0
            for symbol, bar in zip(symbols, numbers):
                while at < len(due) and due[at][0] <= bar:
                    levels.add(due[at][1])
                    at += 1
                if at:
                    for c, v in zip(columns.values(), (symbol, bar, kind, len(levels.zones), at, levels.lows[0], levels.highs[-1])):
                        c.append(v)
        types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({name: pa.array(v, t) for (name, v), t in zip(columns.items(), types)})

    return per_symbol_of_both(rows.select(F.col("symbol_id").cast("long").alias("symbol_id"), F.col("bar").cast("int").alias("bar")), extremes.select("symbol_id", "lows", "highs"), walk, COUNTED)


def nearest_below(zones: Column, price: Column) -> Column:
    """The zone with the highest middle whose high is below price."""
    z = F.array_max(F.transform(F.filter(zones, lambda z: z["high"] < price), lambda z: F.struct(z["mid"].alias("mid"), z["low"].alias("low"), z["high"].alias("high"), z["touches"].alias("touches"))))
    return z


def nearest_above(zones: Column, price: Column, min_touches: int = 2, min_mid: Column | None = None) -> Column:
    """The zone with the lowest middle whose low is above price, tested min_touches times."""
    fits = lambda z: (z["low"] > price) & (z["touches"] >= min_touches) & (F.lit(True) if min_mid is None else z["mid"] >= min_mid)
    return F.array_min(F.transform(F.filter(zones, fits), lambda z: F.struct(z["mid"].alias("mid"), z["low"].alias("low"), z["high"].alias("high"), z["touches"].alias("touches"))))
