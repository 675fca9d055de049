"""Zones that grow price by price, against clustering anew."""

import random
import time

from pyspark.sql import functions as F

from tidemark.operators import zones as Z
from tidemark.operators.zones import Levels


def clustered(prices, pct=0.02):
    zones = []
    for p in sorted(prices):
        if zones:
            low, high, n = zones[-1]
            mid = (low + high) / 2
            if mid > 0 and (p - mid) / mid <= pct:
                zones[-1] = (low, p, n + 1)
                continue
        zones.append((p, p, 1))
    return zones


def test_zones_after_each_price_equal_those_of_all():
    rnd = random.Random(3)
    for _ in range(150):
        levels, prices, spread = Levels(), [], rnd.choice([3, 30, 300])
        for _ in range(rnd.choice([5, 60])):
            prices.append(round(100 + rnd.random() * spread, rnd.choice([0, 2])))
            levels.add(prices[-1])
            want = clustered(prices)
            assert [(z[0], z[-1], len(z)) for z in levels.zones] == want
            assert levels.lows == [w[0] for w in want] and levels.highs == [w[1] for w in want]
            price, touches, least = round(100 + rnd.random() * spread, 1), rnd.choice([1, 2, 3]), rnd.choice([None, 120.0])
            below = [w for w in want if w[1] < price]
            above = [w for w in want if w[0] > price and w[2] >= touches and (least is None or (w[0] + w[1]) / 2 >= least)]
            listed = lambda z: z and (z["low"], z["high"], z["touches"])
            assert listed(levels.below(price)) == (below[-1] if below else None)
            assert listed(levels.above(price, touches, least)) == (above[0] if above else None)


def test_a_long_history_is_one_pass(spark):
    """50,000 bars of a symbol, zones wanted at each: seconds, and a symbol without extremes has none."""
    bars = spark.range(1, 50_001).select(F.lit(1).cast("long").alias("symbol_id"), F.col("id").cast("int").alias("bar"), (F.lit(100) + 40 * F.sin(F.col("id") / 700) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 250).alias("close"))
    both = bars.unionByName(bars.limit(5).withColumn("symbol_id", F.lit(2).cast("long")))
    found = bars.filter("bar % 5 = 0").select("symbol_id", F.struct(F.col("close").alias("price"), (F.col("bar") + 2).cast("int").alias("confirm_bar")).alias("x"))
    extremes = found.groupBy("symbol_id").agg(F.collect_list("x").alias("lows"), F.collect_list("x").alias("highs"))
    start = time.time()
    got = {(r["symbol_id"], r["bar"]): r for r in Z.with_nearest(both, extremes, F.lit(True), 1).collect()}
    assert time.time() - start < 60 and len(got) == 50_005 and got[2, 5]["support"] is None
    price = {r["bar"]: r["close"] for r in bars.collect()}
    for bar in (7, 1000, 33_333, 50_000):
        zones = clustered([price[b] for b in range(5, bar - 1, 5)])
        below, above = [z for z in zones if z[1] < price[bar]], [z for z in zones if z[0] > price[bar]]
        row = got[1, bar]
        assert (row["support"] and (row["support"]["low"], row["support"]["high"])) == (below[-1][:2] if below else None)
        assert (row["resistance"] and (row["resistance"]["low"], row["resistance"]["high"])) == (above[0][:2] if above else None)
