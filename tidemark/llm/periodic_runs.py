"""Periodic runs of words, by joining the classes of a text's suffixes in order of falling common prefixes.

Suffixes of a text that share their first words are a class.  The edges between neighbours in the
suffix array, taken by falling length of their common prefix (LCP), join classes as in Kruskal's
algorithm; each class keeps its positions in order.  A run of period q and length n makes its
start i and i + q share n - q words; when these two get into one class they are neighbours in it,
as one between them would give a smaller period.  So each pair of positions that become
neighbours, at a distance within the LCP, seeds a run.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, mixed, released
from .words import BLANK, words_of

#: A run has this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The start of a run shares this many words at least with what follows after a period.
LEAST_SHARED = min(max(LEAST_WORDS, LEAST_PERIODS * q) - q for q in range(1, LEAST_WORDS))

#: Bytes of text that a worker takes at a time, but for a longer text.
SLICE = 1 << 22


def repeated_places(codes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Places whose n words come again in the same text; some others too, where hashes meet."""
    size = max(0, len(codes) - n + 1)
    whole = np.flatnonzero(text[:size] == text[n - 1 :]) if size else np.zeros(0, np.int64)
    gram = text[whole].astype(np.uint64)
    for k in range(n):
        gram = mixed(gram + codes[whole + k].astype(np.uint64) + np.uint64(1))
    bits = max(10, int(8 * len(whole) + 1).bit_length())
    for shift in (64 - bits, 0):  # most places are alone in their slot
        slot = ((gram >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        held = np.bincount(slot, minlength=1 << bits)[slot] > 1
        whole, gram = whole[held], gram[held]
    _, back, count = np.unique(gram, return_inverse=True, return_counts=True)
    return whole[count[back] > 1] if len(whole) else whole


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks of the first 1, 2, 4, ... symbols) of a sequence, by doubling; only tied suffixes are sorted again."""
    size = len(symbols)
    _, rank, count = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[rank].astype(np.int32)
    levels, width = [rank], 1
    held = np.flatnonzero(np.bincount(rank, minlength=size)[rank] > 1)
    while len(held):
        beyond = held + width
        after = np.where(beyond < size, rank[np.minimum(beyond, size - 1)], -1)
        order = np.lexsort((after, rank[held]))
        held, after = held[order], after[order]
        old = rank[held]
        new_group = np.concatenate([[True], old[1:] != old[:-1]])
        new_rank = new_group | np.concatenate([[True], after[1:] != after[:-1]])
        at = np.arange(len(held))
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        rank_at = np.maximum.accumulate(np.where(new_rank, at, 0))
        rank = rank.copy()
        rank[held] = old + (rank_at - group_at)
        alone = new_rank & np.concatenate([new_rank[1:], [True]])
        held = np.sort(held[~alone])
        levels.append(rank)
        width *= 2
    order = np.empty(size, np.int64)
    order[rank] = np.arange(size)
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix in order shares with the next one."""
    a, b = order[:-1].copy(), order[1:].copy()
    size, shared = len(order), np.zeros(max(0, len(order) - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        open_ = np.flatnonzero((a < size) & (b < size))
        same = open_[levels[k][a[open_]] == levels[k][b[open_]]]
        for x in (a, b, shared):
            x[same] += 1 << k
    return shared


def seeded_runs(symbols: list[int], a: list[int], b: list[int], shared: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, from pairs of neighbours in the suffix array by falling LCP.

    A union costs the smaller class's size times a search in the larger one, n log n in all, and
    an insertion into its sorted list.
    """
    parent = list(range(len(symbols)))
    positions: list[list[int] | None] = [[i] for i in range(len(symbols))]
    runs = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def seed(i: int, j: int, lcp: int) -> None:
        period = j - i
        if (LEAST_PERIODS - 1) * period <= lcp and period + lcp >= LEAST_WORDS and (i == 0 or symbols[i - 1] != symbols[j - 1]):
            runs.append((i, period + lcp, period))

    for x, y, lcp in zip(a, b, shared):
        x, y = root(x), root(y)
        large, small = positions[x], positions[y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        parent[y] = x
        positions[y] = None
        if 2 * len(small) < len(large):
            for p in small:
                insort(large, p)
        else:
            large.extend(small)
            large.sort()  # two runs in order: a merge
        last = len(large) - 1
        for k, p in enumerate(small):
            at = bisect_left(large, p)
            if at and (not k or large[at - 1] != small[k - 1]):
                seed(large[at - 1], p, lcp)
            if at < last and (k + 1 == len(small) or large[at + 1] != small[k + 1]):
                seed(p, large[at + 1], lcp)
    return runs


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of some texts, by text, start and period.

    codes are words as numbers, bounds the texts' places in them.  Only stretches of words that
    come again in their text, LEAST_SHARED at a time, are sorted: no other has a run.
    """
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    again = repeated_places(codes, text, LEAST_SHARED)
    if not len(again):
        return np.zeros((0, 4), np.int64)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + LEAST_SHARED, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    # a symbol of its own after each stretch
    stretch = np.concatenate([[0], np.cumsum((np.diff(kept) > 1) | (np.diff(text[kept]) > 0))])
    at = np.arange(len(kept)) + stretch
    _, word = np.unique(text[kept] * (int(codes.max()) + 1) + codes[kept], return_inverse=True)
    symbols = np.full(len(kept) + int(stretch[-1]) + 1, -1, np.int64)
    symbols[at] = word
    gaps = np.flatnonzero(symbols < 0)
    symbols[gaps] = len(kept) + np.arange(len(gaps))
    order, levels = suffix_order(symbols)
    shared = common_prefixes(order, levels)
    del levels
    pairs = np.flatnonzero(shared >= LEAST_SHARED)
    pairs = pairs[np.argsort(-shared[pairs], kind="stable")]
    runs = np.array(seeded_runs(symbols.tolist(), order[pairs].tolist(), order[pairs + 1].tolist(), shared[pairs].tolist()), np.int64).reshape(-1, 3)
    origin = np.zeros(len(symbols), np.int64)
    origin[at] = kept
    start = origin[runs[:, 0]]
    found = np.stack([text[start], start - bounds[text[start]], runs[:, 1], runs[:, 2]], axis=1)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def best_run(runs: np.ndarray) -> tuple[int, int, int]:
    """The (start, length, period) of the greatest length / period, then of the smallest start and period; ratios are compared as whole numbers."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def beyond_first_period(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words are in a run, after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def planted_order(doc_id: int, n: int) -> np.ndarray | None:
    """The word that each of a document's n words becomes: a tenth of the documents, by crc32 of the id, repeat a stretch to their end."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


RUNS = "array<struct<start:long,length:long,period:long>>"


def _joined(flat: pa.Array, places: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The words at places of each text, with single spaces."""
    words = flat.take(pa.array(places))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), words), pa.scalar(b" ", words.type)).to_pylist()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of each text, and the text without what a run repeats.

    Words are what ASCII white space leaves.  A run is a stretch of consecutive words with smallest
    period q and at least max(6, 4 * q) words that no neighbour extends with that period; runs
    are in order of start, then period.  collapsed has the words that no run contains after its
    first q words, with single spaces.  planted first replaces words as planted_order says.

    Null and empty texts have no runs and an empty collapsed text; repeated rows and null ids
    stay, each judged alone (planted leaves null ids as they are); other columns are left out, as
    are clashing ones; an empty table gives no rows.  Rows don't move.  A text is searched whole, in
    memory of about 4 bytes for each repeated word and doubling of the longest repeat.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1, SLICE):
            words = words_of(batch.column(1), BLANK)
            bounds, order = words.bounds, np.arange(len(words.flat))
            if planted:
                for k, doc_id in enumerate(batch.column(0).to_pylist()):
                    new = None if doc_id is None else planted_order(doc_id, int(bounds[k + 1] - bounds[k]))
                    if new is not None:
                        order[bounds[k] : bounds[k + 1]] = bounds[k] + new
            codes = words.coded()[0][order].astype(np.int64)
            runs = find_runs(codes, bounds)
            keep = np.ones(len(codes), bool)
            ends = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1))
            for k in np.unique(runs[:, 0]).tolist():
                keep[bounds[k] : bounds[k + 1]] = ~beyond_first_period(int(bounds[k + 1] - bounds[k]), runs[ends[k] : ends[k + 1], 1:])
            kept_bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            collapsed = pa.array(_joined(words.flat, order[keep], kept_bounds), pa.binary()).cast(pa.string())
            fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, c])) for c in (1, 2, 3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields).cast(kind), collapsed], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(search), f"doc_id long, runs {RUNS}, collapsed string")


def run_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row of docs, with the planted repeats.

    The four are those of the run with the greatest length / period, null without runs; cases are
    periodic_runs's.
    """

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for runs, collapsed in zip(batch.column(1).to_pylist(), batch.column(2)):
                found = np.array([(r["start"], r["length"], r["period"]) for r in runs], np.int64).reshape(-1, 3)
                start, length, period = best_run(found) or (None, None, None)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
                text = collapsed.as_buffer()
                for column, x in zip(columns, (len(found), start, length, period, None if length is None else 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())):
                    column.append(x)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return periodic_runs(docs, planted=True).mapInArrow(digest, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
