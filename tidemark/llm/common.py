"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Small sides are broadcast up to this many rows, checked at run time.
BROADCAST_ROWS = 20_000

#: Bits of the filter that keeps documents without marks out of a shuffle: 1 MB.
FILTER_BITS = 1 << 23

_own_dir: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local master may do without, in a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _own_dir[app]


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else unchanged for a shuffled join.

    df should be cheap to count: read from a written table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hub_join(rows: DataFrame, small: DataFrame, key: str, weight: str) -> DataFrame:
    """rows inner joined with small, which has one row for each key and a weight that grows with the key's rows.

    Keys with more than 1 / BROADCAST_ROWS of all weight are broadcast, fewer than BROADCAST_ROWS of
    them; the others meet in a shuffle, in which none of them is large.  small is read several
    times: a written table, best.
    """
    n, total = small.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).collect()[0]
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key)
    heavy = F.col(weight) * BROADCAST_ROWS > F.lit(total)
    hubs = F.broadcast(small.filter(heavy))
    rest = rows.join(hubs.select(key), key, "left_anti").join(small.filter(~heavy), key)
    return rows.join(hubs, key).unionByName(rest)


def marked(rows: DataFrame, marks: DataFrame, key: str, yes: bool = True) -> DataFrame:
    """Rows whose key passes a filter built from the keys of marks, or fails it.

    All rows with a mark pass; so do some others, more the larger the tables are.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bitmaps = marks.select(key).distinct().select((slot + 1).alias("k")).groupBy(F.bitmap_bucket_number("k").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("_bits"))
    bitmaps = F.broadcast(written(bitmaps, "filter"))  # FILTER_BITS at most
    keyed = rows.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number(F.col("_slot") + 1))
    inside = F.col("_slot") % 32768
    byte = F.conv(F.hex(F.substr(F.col("_bits"), (inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), inside % 8)) % 2 == 1, F.lit(False))
    joined = keyed.join(bitmaps, "_bucket", "left")
    return joined.filter(hit if yes else ~hit).select(*rows.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released(mapper: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapper, after which the worker gives Arrow's free memory back: it stays for later stages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from mapper(batches)
        pa.default_memory_pool().release_unused()

    return run


def byte_slices(batches: Iterable[pa.RecordBatch], column: int | str, limit: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose column holds limit bytes at most, but for a longer value, and of so many rows at most."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, "right")))
            last = last if rows is None else min(last, first + rows)
            yield batch.slice(first, last - first)
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")).cast("string").cast("binary")), F.lit(modulus))


def hash_share(key: str | Column, seed: str) -> Column:
    """A reproducible uniform number in [0, 1) from the md5 of seed and key."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
