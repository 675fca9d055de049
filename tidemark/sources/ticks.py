"""Binary market-data frames to ticks."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "frame long, packet int, size int, token long, tradable boolean, last_price double, last_qty long, volume long, open double, high double, low double, close double, exchange_time long, oi long, bids array<struct<price:double,qty:long,orders:int>>, asks array<struct<price:double,qty:long,orders:int>>, error string"
LEVEL = pa.list_(pa.struct([("price", pa.float64()), ("qty", pa.int64()), ("orders", pa.int32())]))
ARROW = pa.schema([
    ("frame", pa.int64()), ("packet", pa.int32()), ("size", pa.int32()), ("token", pa.int64()), ("tradable", pa.bool_()), ("last_price", pa.float64()), ("last_qty", pa.int64()), ("volume", pa.int64()),
    ("open", pa.float64()), ("high", pa.float64()), ("low", pa.float64()), ("close", pa.float64()), ("exchange_time", pa.int64()), ("oi", pa.int64()), ("bids", LEVEL), ("asks", LEVEL), ("error", pa.string()),
])


def packet_fields(packet: bytes) -> dict:
    """Fields of a packet by its length; prices are signed hundredths. Unknown lengths have the last price only."""
    out: dict = {"size": len(packet), "token": int.from_bytes(packet[:4], "big"), "tradable": len(packet) not in (28, 32)}
    price = lambda at: struct.unpack_from(">i", packet, at)[0] / 100
    number = lambda at: struct.unpack_from(">I", packet, at)[0]
    if len(packet) >= 8:
        out["last_price"] = price(4)
    if len(packet) in (28, 32):
        out |= {"high": price(8), "low": price(12), "open": price(16), "close": price(20)}
        out |= {"exchange_time": number(28)} if len(packet) == 32 else {}
    if len(packet) in (44, 184):
        out |= {"last_qty": number(8), "volume": number(16), "open": price(28), "high": price(32), "low": price(36), "close": price(40)}
    if len(packet) == 184:
        levels = [{"qty": number(at), "price": price(at + 4), "orders": struct.unpack_from(">H", packet, at + 8)[0]} for at in range(64, 184, 12)]
        out |= {"oi": number(48), "exchange_time": number(60), "bids": levels[:5], "asks": levels[5:]}
    return out


def frame_packets(data: bytes | None) -> Iterator[dict]:
    """Packets of a frame; a frame that ends early yields those before, then an error. Heartbeats yield nothing."""
    if data is None or len(data) <= 1:
        return
    if len(data) < 4:
        yield {"packet": 0, "error": "short frame"}
        return
    at = 2
    for k in range(int.from_bytes(data[:2], "big")):
        size = int.from_bytes(data[at : at + 2], "big")
        if at + 2 > len(data) or at + 2 + size > len(data):
            yield {"packet": k, "error": "truncated"}
            return
        if 0 < size < 4:
            yield {"packet": k, "error": "short packet"}
            return
        if size:
            yield {"packet": k, **packet_fields(data[at + 2 : at + 2 + size])}
        at += 2 + size


def decode_frames(frames: DataFrame) -> DataFrame:
    """A row per packet of (frame, data), and one with an error for each bad frame, in one pass without a shuffle."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, data = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_pylist([{"frame": i, **p} for i, x in zip(frames, data) for p in frame_packets(x)], ARROW)

    return frames.select(F.col("frame").cast("long").alias("frame"), "data").mapInArrow(decode, SCHEMA)


def price_frames(ticks: DataFrame, per_frame: int = 8) -> DataFrame:
    """(frame, data) from (token, last_price, seq): frames of last-price packets, as a feed sends them."""
    hexed = lambda c, width: F.lpad(F.hex(c), width, "0")
    packet = F.concat(F.lit("0008"), hexed(F.col("token"), 8), hexed(F.round(F.col("last_price") * 100).cast("long"), 8))
    grouped = ticks.groupBy(F.floor(F.col("seq") / per_frame).alias("frame")).agg(F.array_sort(F.collect_list(F.struct("seq", packet.alias("p")))).alias("x"))
    return grouped.select("frame", F.unhex(F.concat(hexed(F.size("x").cast("long"), 4), F.array_join(F.transform("x", lambda v: v["p"]), ""))).alias("data"))
