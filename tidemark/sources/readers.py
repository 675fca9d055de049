"""Readers of candle files, provider JSON, instrument and sector files, and watchlists."""

from __future__ import annotations

import csv
import datetime as dt
import functools
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import norm_symbol
from .shared import written

# The date layouts of candle files, tried in this order.
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "M/d/yyyy H:mm:ss", "M/d/yyyy")
COLUMNS = ("date", "open", "high", "low", "close", "volume")


def parsed_time(text: Column) -> Column:
    """The time that a text gives by the first layout it fits; one whose marks it lacks isn't tried, as a failed try is dear."""
    text = F.trim(text)
    marked = lambda layout: [F.contains(text, F.lit(m)) for m in sorted(set(re.sub(r"[A-Za-su-z]|(?<!')T|'", "", layout)))]
    tries = []
    for layout in DATE_LAYOUTS:
        fits = F.lit(True)
        for mark in marked(layout):
            fits &= mark
        tries.append(F.when(fits, F.try_to_timestamp(text, F.lit(layout))))
    return F.coalesce(*tries)


#: Splits, of files that have several, up to which what is known of each is broadcast to their lines.
BROADCAST_BLOCKS = 20_000


def numbered_lines(spark: SparkSession, path: str, chosen: Column | None = None) -> DataFrame:
    """(file, line, header, text) of the lines of text files, blank ones left out: line is the number in the file, from 1, and header its first line.

    chosen is a condition on _metadata, by which files are left out before they are opened.

    Files are split between tasks.  A line's number is its place in its split, which a task counts
    as it reads, and the lines of the file's splits before.  Only the splits of files that have
    several are joined to their lines, so any number of small files costs no join; the lines are
    written once, so that both counts see the same splits.
    """
    files = spark.read.option("basePath", path).text(path)
    lines = (files if chosen is None else files.filter(chosen)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text")).filter(F.trim("text") != "")
    lines = written(lines.mapInArrow(_places, "file string, block long, place long, first string, text string"), "lines")
    # a row a split, with the number of its last line
    blocks = lines.groupBy("file", "block").agg(F.max("place").alias("n"), F.any_value("first").alias("header"))
    by_file = W.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n").over(by_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    several = blocks.select("file", "block", before.alias("before"), F.first("header").over(by_file).alias("header"), F.count("*").over(W.partitionBy("file")).alias("splits")).filter("splits > 1").drop("splits")
    several = written(several, "blocks")
    few = several.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    numbered = lines.join(F.broadcast(several) if few else several, ["file", "block"], "left")
    return numbered.select("file", (F.col("place") + F.coalesce("before", F.lit(0))).alias("line"), F.coalesce("header", "first").alias("header"), "text")


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, place, first, text): a line's place in its split, from 1, and the split's first line; a task's lines come split by split."""
    last, count, first = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        code = file.indices.to_numpy()
        begun = np.concatenate([[(file[0].as_py(), int(block[0])) != last], (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        starts = np.flatnonzero(begun)
        run = np.cumsum(begun)  # 0: the split that the batch before ended with
        texts = batch.column("text")
        heads = pa.concat_arrays([pa.array([first], pa.string()), texts.take(pa.array(starts))])
        place = np.arange(1, batch.num_rows + 1) - np.concatenate([[-count], starts])[run]
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(place, pa.int64()), heads.take(pa.array(run)), texts], names=["file", "block", "place", "first", "text"])
        last, count, first = (file[-1].as_py(), int(block[-1])), int(place[-1]), heads[int(run[-1])].as_py()


#: Bytes up to which a file that isn't compressed is read whole, by one task.
WHOLE_BYTES = 4 << 20
COMPRESSED = r"(?i)\.(gz|bz2|deflate|lz4|lzo|snappy|xz|zst|zstd)$"
#: Lines that a task hands on at once, about.
BATCH_LINES = 20_000
#: A line: its time by the clock and its numbers where their texts are plain; odd has what else is needed to judge or reject it.
ODD = "struct<file:string,text:string,missing:string," + ",".join(f"{c}:string" for c in COLUMNS) + ">"
CELLS = f"symbol string, line long, date timestamp_ntz, open double, high double, low double, close double, volume long, odd {ODD}"
CLOCK = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?: ([0-9]{2}):([0-9]{2}):([0-9]{2}))?")
US_CLOCK = re.compile(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?: ([0-9]{1,2}):([0-9]{2}):([0-9]{2}))?")
#: A cell that is quoted to its end, one whose quote doesn't end, or anything up to a comma.
CELL = re.compile(r'\s*"((?:[^"\\]|""|\\.)*)"\s*(?:,|\Z)|(\s*"(?:[^"\\]|""|\\.)*\Z)|([^,]*)(?:,|\Z)')


def _odd_cells(line: str) -> list[str]:
    """The cells of a line that has a quote where none should be: a cell isn't quoted then, and one that doesn't end is the rest of the line."""
    cells, at = [], 0
    while True:
        m = CELL.match(line, at)
        quoted, unended, plain = m.groups()
        cells.append(re.sub(r'""|\\(.)', lambda x: x[1] or '"', quoted) if quoted is not None else unended or plain)
        at = m.end()
        if unended or not m[0].endswith(","):
            return cells


def _split(lines: list[str]) -> list[list[str]]:
    """The cells of each line; a quoted cell can't go over lines."""
    try:
        rows = list(csv.reader(lines, strict=True, skipinitialspace=True))
    except csv.Error:
        rows = []
    return rows if len(rows) == len(lines) else [_odd_cells(line) for line in lines]


@functools.lru_cache(4096)
def _header(header: str) -> tuple[tuple[int | None, ...], str | None]:
    """Where the header has each of COLUMNS, and what it lacks first."""
    names = [c.strip().lower() for c in _split([header])[0]]
    places = tuple(names.index(c) if c in names else None for c in COLUMNS)
    return places, next((f"missing {c}" for c, k in zip(COLUMNS, places) if k is None), None)


@functools.lru_cache(4096)
def _named(file: str) -> tuple[str, str]:
    """(symbol, file) of a file's URI: the symbol is that of a folder symbol=NAME, else the file's name."""
    file = unquote(file)
    folder = re.search(r"symbol=([^/]+)/", file)
    base = re.search(r"(?i)([^/]+?)(\.csv)?(\.gz)?$", file)
    return (folder[1] if folder else base[1] if base else "").strip(" ").upper(), file


@functools.lru_cache(1 << 16)
def _clock(text: str | None) -> dt.datetime | None:
    """The time by the clock of a text in one of DATE_LAYOUTS without an offset; none if that isn't plain."""
    found, us = CLOCK.fullmatch(text or ""), US_CLOCK.fullmatch(text or "")
    if not found and not us:
        return None
    first, second, third, *time = (int(v or 0) for v in (found or us).groups())
    try:
        return dt.datetime(first, second, third, *time) if found else dt.datetime(third, first, second, *time)
    except ValueError:
        return None


def _number(texts: pa.Array, plain: str, kind: pa.DataType) -> pa.Array:
    """The numbers of texts that are plain; null for others."""
    try:
        found = pc.cast(texts, kind)
    except pa.ArrowInvalid:
        found = None
    if found is None or pa.types.is_integer(kind) and pc.any(pc.match_substring(texts, "x", ignore_case=True)).as_py():  # hexadecimal
        found = pc.cast(pc.if_else(pc.match_substring_regex(texts, plain), texts, None), kind)
    return pc.if_else(pc.is_finite(found), found, None)


class _Lines:
    """CELLS of the lines that are added."""

    def __init__(self):
        self.files, self.sizes, self.lines, self.texts, self.missing = [], [], [], [], []
        self.cells: list[list[str | None]] = [[] for _ in COLUMNS]

    def add(self, file: str, header: str, lines: Sequence[int], texts: list[str]) -> None:
        """Lines of a file, none of which is its header; those of a header that lacks a column are left out."""
        places, missing = _header(header)
        if missing or not texts:
            return
        rows = _split(texts)
        whole = min(map(len, rows)) > max(places)
        cells = list(zip(*map(itemgetter(*places), rows))) if whole else [[r[k] if k < len(r) else None for r in rows] for k in places]
        self._add(file, lines, texts, None, cells)

    def add_header(self, file: str, header: str) -> None:
        """A file's header, if it lacks a column."""
        missing = _header(header)[1]
        if missing:
            self._add(file, [1], [header], missing, [[None]] * len(COLUMNS))

    def _add(self, file: str, lines: Sequence[int], texts: list[str], missing: str | None, cells: Sequence[Sequence[str | None]]) -> None:
        self.files.append(file)
        self.sizes.append(len(texts))
        self.missing.append(missing)
        self.lines.extend(lines)
        self.texts.extend(texts)
        for column, found in zip(self.cells, cells):
            column.extend(found)

    def batch(self) -> pa.RecordBatch:
        of_file = np.repeat(np.arange(len(self.sizes)), self.sizes)
        symbols, files = zip(*map(_named, self.files)) if self.files else ((), ())
        cells = [pc.ascii_trim_whitespace(pa.array(c, pa.string())) for c in self.cells]
        days = cells[0].dictionary_encode()
        times = pa.array([_clock(t) for t in days.dictionary.to_pylist()], pa.timestamp("us")).take(days.indices)
        prices = [_number(c, r"^-?[0-9]{1,30}(\.[0-9]{1,30})?$", pa.float64()) for c in cells[1:-1]]
        volumes = _number(pc.replace_substring(cells[-1], ",", ""), "^-?[0-9]{1,18}$", pa.int64())
        plain = [times, *prices, volumes]
        good = functools.reduce(pc.and_, map(pc.is_valid, plain)).to_numpy(zero_copy_only=False).astype(bool)
        bad = np.flatnonzero(~good)
        known = [pa.array(v, pa.string()).take(pa.array(of_file[bad])) for v in (files, self.missing)]
        odd = pa.StructArray.from_arrays([known[0], pa.array([self.texts[k] for k in bad], pa.string()), known[1], *[pc.if_else(pc.is_valid(p), None, c).take(pa.array(bad)) for c, p in zip(cells, plain)]], names=["file", "text", "missing", *COLUMNS])
        odd = odd.take(pa.array(np.cumsum(~good) - 1, pa.int64(), mask=good))
        return pa.RecordBatch.from_arrays([pa.array(symbols, pa.string()).take(pa.array(of_file)), pa.array(self.lines, pa.int64()), *plain, odd], names=["symbol", "line", *COLUMNS, "odd"])


def _cells_of_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CELLS of whole files (file, content)."""
    out = _Lines()
    for batch in batches:
        for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
            text = content.as_py().removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
            if "\r" in text:
                text = text.replace("\r\n", "\n").replace("\r", "\n")
            lines = [line for line in text.split("\n") if line and (line[0] != " " or line.strip(" "))]
            if lines:
                out.add_header(file, lines[0])
                out.add(file, lines[0], range(2, len(lines) + 1), lines[1:])
            if len(out.lines) >= BATCH_LINES:
                yield out.batch()
                out = _Lines()
    yield out.batch()


def _cells_of_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CELLS of numbered_lines."""
    for batch in batches:
        out, rows = _Lines(), zip(*(batch.column(c).to_pylist() for c in ("file", "header", "line", "text")))
        for (file, header), group in groupby(rows, itemgetter(0, 1)):
            lines, texts = map(list, zip(*((line, text) for _, _, line, text in group)))
            if 1 in lines:
                out.add_header(file, header)
                texts.pop(lines.index(1))
                lines.remove(1)
            out.add(file, header, lines, texts)
        yield out.batch()


def judged_candles_csv(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, file, line, text, reason, ts, open .. volume) of the lines of a directory; candles have no reason, nor a file and text.

    The symbol is that of a folder symbol=NAME, else the file's name.  Each file's columns are those
    of its own header, by name, whatever their case and order; others are ignored; volumes may have
    thousands commas.  A row with a bad cell is a reject, with its line (blank ones aren't counted)
    and the first bad column, and stops no other; a file whose header lacks a column is one reject,
    its header.  Files up to WHOLE_BYTES are read whole, so their lines are numbered and cut where
    they are read; others and compressed ones are split as text is.
    """
    small = (F.col("_metadata.file_size") <= WHOLE_BYTES) & ~F.col("_metadata.file_name").rlike(COMPRESSED)
    files = spark.read.format("binaryFile").option("basePath", path).load(path)
    whole = files.filter(small).select(F.col("_metadata.file_path").alias("file"), "content")
    # a file counts as some megabytes in a split, so very many small ones are very many splits
    splits = whole.rdd.getNumPartitions()
    tasks = max(16 * spark.sparkContext.defaultParallelism, splits // 32)
    cells = (whole.coalesce(tasks) if splits > tasks else whole).mapInArrow(_cells_of_files, CELLS)
    if not files.filter(~small).select("path").isEmpty():
        cells = cells.unionByName(numbered_lines(spark, path, ~small).mapInArrow(_cells_of_lines, CELLS))
    plain = {"ts": F.col("date").cast("timestamp"), **{c: F.col(c) for c in COLUMNS[1:]}}
    # a failed cast is dear: what can't be a number isn't tried
    number = lambda c, like, kind: F.when(c.rlike(like), c.try_cast(kind))
    prices = {c: number(F.col(f"odd.{c}"), "(?i)[0-9]|inf|nan", "double") for c in COLUMNS[1:-1]}
    volume = number(F.replace("odd.volume", F.lit(","), F.lit("")), r"^[\x00-\x20\x7f-\x9f]*[+-]?[0-9]+[\x00-\x20\x7f-\x9f]*$", "bigint")
    tried = {"ts": parsed_time(F.col("odd.date")), **prices, "volume": volume}
    # inline, so that a filter on the reason stays above it and nothing is tried twice
    rows = cells.select("symbol", "line", "odd", F.inline(F.array(F.struct(*[F.coalesce(v, tried[c]).alias(c) for c, v in plain.items()]))))
    rows = rows.withColumn("reason", F.coalesce("odd.missing", *[F.when(F.col(c).isNull(), F.lit(c)) for c in plain]))
    return rows.select("symbol", *[F.when(F.col("reason").isNotNull(), F.col(f"odd.{c}")).alias(c) for c in ("file", "text")], "line", "reason", *plain)


def read_candles_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(candles, rejects (symbol, file, line, text, reason)) of judged_candles_csv, written, so that the files are read once."""
    judged = written(judged_candles_csv(spark, path), "judged")
    return judged.filter("reason is null").select("symbol", "ts", "open", "high", "low", "close", "volume"), judged.filter("reason is not null").select("symbol", "file", "line", "text", "reason")


def parse_candles_json(payloads: DataFrame) -> DataFrame:
    """(symbol, i, ts, open .. volume) from (symbol, json) provider answers; others than a success have no rows."""
    answer = F.from_json("json", "status string, data struct<candles:array<array<string>>>")
    rows = payloads.select("symbol", answer.alias("a")).filter("a.status = 'success'").select("symbol", F.posexplode("a.data.candles").alias("i", "c"))
    ts = F.coalesce(*[F.try_to_timestamp(F.get("c", 0), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")])
    return rows.select("symbol", "i", ts.alias("ts"), *[F.get("c", k + 1).cast("double").alias(n) for k, n in enumerate(("open", "high", "low", "close"))], F.get("c", 5).cast("double").cast("bigint").alias("volume"))


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """(token, symbol, name, kind, segment, exchange), upper-case and trimmed."""
    raw = spark.read.option("header", True).csv(path, inferSchema=False)
    clean = lambda c: F.upper(F.trim(F.col(c)))
    return raw.select(F.trim("instrument_token").cast("long").alias("token"), clean("tradingsymbol").alias("symbol"), clean("name").alias("name"), clean("instrument_type").alias("kind"), clean("segment").alias("segment"), clean("exchange").alias("exchange"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): without blanks and # comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not line like '#%'")


def read_sector_map(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, sector) from lines symbol,sector, with or without a header, both normalised."""
    pair = F.split("line", ",")
    rows = read_lines(spark, path).select(norm_symbol(F.get(pair, 0)).alias("symbol"), norm_symbol(F.get(pair, 1)).alias("sector"))
    return rows.filter("symbol <> 'SYMBOL' and symbol <> '' and sector <> ''")


def resolve(wanted: DataFrame, instruments: DataFrame) -> DataFrame:
    """(wanted, token): the first equity of a symbol, else the first whose name without white space is the same.

    Two equi-joins rather than one on either condition.
    """
    equity = instruments.filter("kind = 'EQ'")
    by_symbol = wanted.join(equity, wanted["wanted"] == equity["symbol"]).select("wanted", F.lit(0).alias("way"), "token")
    by_name = wanted.join(equity, F.regexp_replace("wanted", r"\s+", "") == F.regexp_replace("name", r"\s+", "")).select("wanted", F.lit(1).alias("way"), "token")
    first = by_symbol.unionByName(by_name).groupBy("wanted").agg(F.min(F.struct("way", "token")).alias("x"))
    return first.select("wanted", "x.token")
