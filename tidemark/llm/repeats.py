"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

Every string of `width` bytes contains an anchor, the place where a hash of GRAM bytes is smallest,
which depends on the string alone.  A batch's suffix array holds its anchors in the order of the
bytes that start there, range-partitioned.  It is merge-scanned against the arrays of earlier
batches: neighbours that share GRAM bytes or more may be in equal strings.  Arrays of equal rank
merge in the same scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, mixed, shuffle_partitions, written

#: Bytes that an anchor's hash covers, and bytes of its suffix that are kept.
GRAM = 24
#: Bytes of text that are worked on at a time, but for a longer text.
CHUNK = 1 << 20

_random = np.random.default_rng(20)
BYTE_CODES = _random.integers(0, 2**64, 256, np.uint64, endpoint=False)
_M, _N = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Base of the hashes of stretches, odd, and its inverse modulo 2 ** 64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) <= n:
        p = np.full(max(n, CHUNK + (CHUNK >> 2)) + 1, base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base]


class Chunk:
    """Texts as one array of bytes, with hashes of their stretches."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.codes = BYTE_CODES[self.raw]
        self.sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum(self.codes * powers(BASE, len(self.codes))[: len(self.codes)], out=self.sums[1:])

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the bytes from a to b."""
        return mixed((self.sums[b] - self.sums[a]) * powers(INVERSE, len(self.codes))[a] + (b - a).astype(np.uint64) * _N)

    def grams(self) -> np.ndarray:
        """A hash of the GRAM bytes at each place."""
        h, step, whole, done = self.codes, 1, None, 0
        while step <= GRAM:
            if GRAM & step:
                part = h[done:]
                whole = part if whole is None else whole[: len(part)] * _M + part * _N
                done += step
            h = h[:-step] * _M + h[step:] * _N
            h ^= h >> np.uint64(29)
            step *= 2
        return mixed(whole)

    def anchors(self, width: int) -> tuple[np.ndarray, ...]:
        """(text's number, hash, first window, last window, anchor) of each anchor; places are in the chunk.

        The windows are the strings of `width` bytes whose anchor it is, all of one text.
        """
        none = np.zeros(0, np.int64)
        if len(self.codes) < width:
            return none, none.astype(np.uint64), none, none, none
        h = self.grams()
        bits = np.uint64(len(h).bit_length())
        key = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
        span, reach = width - GRAM + 1, 1
        while reach * 2 <= span:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < span:
            key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
        at = (key & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        windows = np.concatenate([np.arange(b, b + n - width + 1) for b, n in zip(self.begins, self.sizes) if n >= width] or [none])
        if not len(windows):
            return none, none.astype(np.uint64), none, none, none
        at = at[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(windows)) - 1
        return np.searchsorted(self.begins + self.sizes, windows[first], "right"), h[at[first]], windows[first], windows[last], at[first]


#: Stretches with the same GRAM bytes that one task compares; those of more frequent ones are dealt by window.
GROUP = 512
#: Equal parts of the doc_id range that enter the index one after the other.
BATCHES = 3
NULL_ID = -(2**63)


def binaries(*blocks: np.ndarray) -> pa.Array:
    """The rows of matrices of bytes, one matrix after the other."""
    sizes = np.concatenate([np.full(len(b), b.shape[1], np.int32) for b in blocks])
    offsets = np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(np.ascontiguousarray(b).tobytes() for b in blocks))])


def suffixes(rows: DataFrame, width: int) -> DataFrame:
    """(suffix, cx, doc, start) from (doc, text): an entry for each anchor, unsorted.

    suffix is the first GRAM bytes of the anchor's suffix; cx packs a hash of the stretch that the
    anchor's windows cover, the anchor's offset in it and its length beyond width.  Entries with the
    suffix and cx of an earlier one of the batch are left out; what they cover is a row of its own
    for each stretch, with -length as cx and eight bytes of a hash as suffix.
    """
    bits = width.bit_length()

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), [(t or "").encode() for t in batch.column(1).to_pylist()]
            found: list[tuple[np.ndarray, ...]] = []
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                    size += len(texts[last])
                    last += 1
                chunk = Chunk(texts[first:last])
                number, h, a, b, at = chunk.anchors(width)
                cx = chunk.stretch(a, b + width) >> np.uint64(2 * bits + 1)
                cx = (cx.astype(np.int64) << bits | at - a) << bits | b - a
                found.append((h, cx, ids[first + number], a - chunk.begins[number], b - a + width, chunk.raw[at[:, None] + np.arange(GRAM)]))
                first = last
            if not found:
                continue
            h, cx, doc, start, size, suffix = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc, cx, h))
            h, cx, doc, start, size = h[order], cx[order], doc[order], start[order], size[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (cx[1:] != cx[:-1])
            d, s, n = merged_stretches(doc[~fresh], start[~fresh], size[~fresh])
            own = mixed(d.astype(np.uint64) * _M + s.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
            columns = [binaries(suffix[order][fresh], own), *map(pa.array, (np.concatenate([cx[fresh], -n]), np.concatenate([doc[fresh], d]), np.concatenate([start[fresh], s])))]
            yield pa.RecordBatch.from_arrays(columns, names=["suffix", "cx", "doc", "start"])

    return rows.mapInArrow(entries, "suffix binary, cx long, doc long, start long")


def merged_stretches(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of documents, those that touch or overlap as one."""
    if not len(doc):
        return doc, start, size
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    other = np.ones(len(doc), bool)
    other[1:] = doc[1:] != doc[:-1]
    group = np.cumsum(other)
    # ends are raised by what no document exceeds, so that a running maximum starts anew in each
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    begins = other.copy()
    begins[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(begins)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1] - start[at]


#: Level of a batch that is scanned.
NEW = -1
SCANNED = "suffix binary, cx long, doc long, start long, level int, role string, edge int"


def neighbours(absorbed: frozenset[int]):
    """Judges entries (suffix, cx, doc, start, level) in their order by their neighbours.

    role is copy for entries of NEW whose whole stretch is earlier, open for first stretches with a
    neighbour that shares their suffix, else sole.  Sole ones are returned if their level is absorbed,
    and the first and last of a task, with its number as edge: their other neighbour is in another
    task.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail, tail_open, tail_edge, begun = TaskContext.get().partitionId(), None, False, False, False

        def judged(table: pa.RecordBatch, keep: np.ndarray, role: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            rows = table.filter(pa.array(keep))
            columns = [*rows.columns, pa.array(role[keep], pa.string()), pa.array(np.full(int(keep.sum()), part, np.int32), mask=~edge[keep])]
            return pa.RecordBatch.from_arrays(columns, names=["suffix", "cx", "doc", "start", "level", "role", "edge"])

        def wanted(level: np.ndarray, role: np.ndarray, edge: np.ndarray) -> np.ndarray:
            return np.where(role == "copy", level == NEW, (role == "open") | edge | np.isin(level, list(absorbed)))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_batches([tail, batch]) if tail is not None else batch
            n, suffix, cx, level = table.num_rows, table.column(0), table.column(1).to_numpy(), table.column(4).to_numpy()
            same, opened, edge = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
            same[1:] = pc.equal(suffix.slice(1), suffix.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            again = same & (np.append(cx[:1] + 1, cx[:-1]) == cx)
            head = np.flatnonzero(~again & (cx >= 0))
            if tail is not None:
                opened[0] = tail_open
            opened[head] |= same[head]
            opened[head[:-1]] |= same[head[1:]]
            if len(head) and not begun:
                begun, edge[head[0]] = True, True
            elif tail is not None:
                edge[0] = tail_edge
            role = np.where(again | (cx < 0), "copy", np.where(opened, "open", "sole"))
            keep = wanted(level, role, edge)
            if len(head):  # what follows its last entry is in the next batch
                keep[head[-1]] = False
                tail, tail_open, tail_edge = table.slice(head[-1], 1), bool(opened[head[-1]]), bool(edge[head[-1]])
            yield judged(table, keep, role, edge)
        if tail is not None:
            yield judged(tail, np.ones(1, bool), np.array(["open" if tail_open else "sole"]), np.ones(1, bool))

    return scan


class SuffixIndex:
    """Levels of suffix entries in suffix order; batches come in ascending order of doc, and levels of equal rank merge."""

    def __init__(self, width: int = 100):
        self.width, self.levels = width, {}  # by rank

    def scan(self, rows: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
        """Merge-scans a batch (doc, text) against all levels, and adds it to them if it is to be kept.

        Returns the copies (doc, start, cx), stretches that are earlier in whole, and the open
        entries (suffix, cx, doc, start), first stretches with a suffix that others have too.
        """
        batch = written(suffixes(rows, self.width), "suffixes", "zstd")
        found = batch.filter("cx >= 0").withColumn("level", F.lit(NEW))
        for rank, table in self.levels.items():
            found = found.unionByName(table.withColumn("level", F.lit(rank)))
        rank = 0
        while keep and rank in self.levels:
            rank += 1
        absorbed = frozenset([NEW, *range(rank)]) if rank else frozenset()
        order = ["suffix", "cx", "doc", "start"]
        ordered = found.repartitionByRange(shuffle_partitions(rows.sparkSession), "suffix", "cx").sortWithinPartitions(*order)
        judged = written(ordered.mapInArrow(neighbours(absorbed), SCANNED), "suffix-scan", "zstd")
        # a suffix that ends a task's entries and begins another's: no more of them than tasks
        shared = judged.filter("edge is not null").groupBy("suffix").agg(F.countDistinct("edge").alias("n")).filter("n > 1").select("suffix")
        parted = judged.filter("edge is not null and role = 'sole'").join(F.broadcast(shared), "suffix")
        opened = judged.filter("role = 'open'").select(*order).unionByName(parted.select(*order))
        if rank:
            for old in range(rank):
                del self.levels[old]
            self.levels[rank] = judged.filter(F.col("level").isin(*absorbed) & (F.col("role") != "copy")).select(*order)
        elif keep:
            self.levels[0] = batch.filter("cx >= 0")
        copies = judged.filter("role = 'copy'").select("doc", "start", "cx")
        return copies.unionByName(batch.filter("cx < 0").select("doc", "start", "cx")), opened


def resolve(rows: DataFrame, opened: DataFrame, width: int, group: int = GROUP) -> DataFrame:
    """(doc, start, size) of repeated windows in open stretches (suffix, cx, doc, start).

    The windows of few stretches meet in one task; those of a suffix that more than `group` stretches
    have are dealt by their own content, in all documents.
    """
    bits = width.bit_length()
    entries = written(opened.select(F.xxhash64("suffix").alias("h"), "doc", "start", "cx").distinct(), "open-entries", "zstd")
    hot = written(entries.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > group), "hot-hashes")
    # a filter's false hits are dealt by window as well, all rows of a hash alike
    entries = marked(entries, hot, "h").withColumn("hot", F.lit(True)).unionByName(marked(entries, hot, "h", yes=False).withColumn("hot", F.lit(False)))
    lists = entries.groupBy("doc").agg(F.collect_list(F.struct("h", "start", "cx", "hot")).alias("places"))
    texts = marked(rows, opened, "doc").join(lists, "doc")
    kind = "key long, doc long, start long, data binary"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                for doc, text, places in zip(*(c.to_pylist() for c in batch.slice(i, 200).columns)):
                    raw, chunk = (text or "").encode(), None
                    for p in places:
                        size = (p["cx"] & (1 << bits) - 1) + width
                        if not p["hot"]:
                            out.append((p["h"], doc, p["start"], raw[p["start"] : p["start"] + size]))
                        else:
                            chunk = chunk or Chunk([raw])
                            a = np.arange(p["start"], p["start"] + size - width + 1)
                            a = a[a + width <= len(raw)]
                            out.extend((k, doc, s, None) for k, s in zip(chunk.stretch(a, a + width).view(np.int64).tolist(), a.tolist()))
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "doc", "start", "data"), x)) for x in out], pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("data", pa.binary())]))

    pieces = written(texts.select("doc", "text", "places").mapInArrow(cut, kind), "stretches", "zstd")

    def compare(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def done(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(["doc", "start"], kind="stable")
            chunk = Chunk(list(f["data"]))
            n = np.maximum(chunk.sizes - width + 1, 0)
            of = np.repeat(np.arange(len(f)), n)
            within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            at = chunk.begins[of] + within
            keys = mixed(chunk.stretch(at, at + width) + f["key"].to_numpy().view(np.uint64)[of] * _M)
            place = f["start"].to_numpy()[of] + within
            docs = f["doc"].to_numpy()[of]
            order = np.lexsort((place, docs, keys))
            keys, docs, place = keys[order], docs[order], place[order]
            first = np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1])[: len(keys)], np.arange(len(keys)), 0))
            again = (docs != docs[first]) | (place != place[first])
            d, s, size = merged_stretches(docs[again], place[again], np.full(int(again.sum()), width))
            return pd.DataFrame({"doc": d, "start": s, "size": size}, dtype="int64")

        for f in frames:
            if not len(f):
                continue
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            unfinished = f["key"] == f["key"].iat[-1]
            held, ready = f[unfinished], f[~unfinished]
            if len(ready):
                yield done(ready)
        if held is not None:
            yield done(held)

    few = pieces.filter("data is not null").repartition("key").sortWithinPartitions("key").mapInPandas(compare, "doc long, start long, size long")
    # of a window's places all but the first are repeats: the first ones of a document tell the others
    first = pieces.filter("data is null").groupBy("key").agg(F.min(F.struct("doc", "start")).alias("first")).select("first.*")
    firsts = first.groupBy("doc").agg(F.collect_list("start").alias("firsts"))
    dealt = entries.filter("hot").groupBy("doc").agg(F.collect_list(F.struct("start", "cx")).alias("places")).join(firsts, "doc", "left")

    def later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 2]
            for doc, places, firsts in zip(*(c.to_pylist() for c in batch.columns)):
                windows = np.concatenate([np.arange(p["start"], p["start"] + (p["cx"] & (1 << bits) - 1) + 1) for p in places])
                again = np.setdiff1d(windows, np.array(firsts or [], np.int64))
                found.append((np.full(len(again), doc), again))
            doc, start = (np.concatenate(x) for x in zip(*found))
            d, s, size = merged_stretches(doc, start, np.full(len(doc), width))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, s, size)], names=["doc", "start", "size"])

    return few.unionByName(dealt.select("doc", "places", "firsts").mapInArrow(later, "doc long, start long, size long"))


def repeated_stretches(rows: DataFrame, width: int = 100, batches: int = BATCHES, group: int = GROUP) -> DataFrame:
    """(doc, start, size) of stretches of (doc, text) that strings of width bytes with an earlier start cover."""
    bounds = rows.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    limits = [None, *sorted(set(map(int, bounds))), None]
    index, copies, opened = SuffixIndex(width), [], []
    for k in range(len(limits) - 1):
        part = rows if limits[k] is None else rows.filter(F.col("doc") >= limits[k])
        part = part if limits[k + 1] is None else part.filter(F.col("doc") < limits[k + 1])
        found = index.scan(part, keep=k < len(limits) - 2)
        copies.append(found[0])
        opened.append(found[1])
    extra = F.when(F.col("cx") < 0, -F.col("cx")).otherwise(F.pmod(F.col("cx"), F.lit(1 << width.bit_length())) + width)
    whole = reduce(DataFrame.unionByName, copies).select("doc", "start", extra.alias("size"))
    return written(whole.unionByName(resolve(rows, reduce(DataFrame.unionByName, opened), width, group)), "repeats")


def remove_repeats(docs: DataFrame, width: int = 100, batches: int = BATCHES, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs; kept is what is left of its bytes.

    A byte goes if a string of width bytes covers it that also starts earlier: in a smaller doc_id,
    or before it in the same document.  Strings never cross documents, may overlap, and are judged
    on the input.

    Null and empty texts, and those shorter than width, lose nothing.  A null doc_id is smaller than
    all others.  Rows that repeat a doc_id are one document in each place: of equal strings at equal
    starts none is earlier, and what goes from one row goes from the same places of the others; if
    their texts differ, a place that is the first of one row's string may stay in the others too.
    Other columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).alias("text"))
    repeats = repeated_stretches(rows, width, batches, group)
    spans = repeats.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                out = []
                for doc, text, places in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns)):
                    raw, kept, last, removed, n = (text or "").encode(), [], 0, 0, 0
                    for start, end in joined(places or (), len(raw)):
                        kept.append(raw[last:start])
                        last, removed, n = end, removed + end - start, n + 1
                    out.append((None if doc == NULL_ID else doc, len(raw), removed, n, b"".join([*kept, raw[last:]])))
                columns = list(zip(*out)) or [()] * 5
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    with_spans = marked(rows, repeats, "doc").join(spans, "doc", "left").select("doc", "text", "spans")
    without = marked(rows, repeats, "doc", yes=False).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return with_spans.unionByName(without).mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def joined(places: Iterable[dict], size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the maximal runs that the places cover, within size."""
    run: list[int] | None = None
    for start, end in sorted((p["start"], min(size, p["start"] + p["size"])) for p in places):
        if run and start <= run[1]:
            run[1] = max(run[1], end)
        else:
            if run:
                yield run[0], run[1]
            run = [start, end] if start < end else None
    if run:
        yield run[0], run[1]


def repeat_digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of docs; the cases are remove_repeats's."""
    stripped = remove_repeats(docs, **options)
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
