"""Benchmark decontamination: rare word pairs of test items seed local alignments in training texts.

No alignment is lost.  One with M matches and E edits of an item of L words scores 2 M - E.  If it
reaches 2 s L, then of the M - 1 steps from a match to the next one at least s L - 1 have one edit
at most, as the others have two or more, E <= 2 M - 2 s L, and M <= L.  Such a step puts two words
that are one or two apart in the item one or two apart in the text, and each starts at another
word of the item.  So if seeds are all pairs from r of the L - 1 starts, the rarest, at least
s L - 1 - (L - 1 - r) of them are in the alignment, whose words in the text are at most
M + E <= (3 - 2 s) L apart.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, released
from .words import ALNUM, Words, words_of

#: Bytes of text that a worker takes at a time, but for a longer text.
SLICE = 1 << 23
#: Bits of the filter that most pairs of words don't pass.
FILTER_BITS = 20

#: Smith-Waterman scores on words.
MATCH, MISMATCH, GAP = 2, -1, -1

LEAK = "struct<item_id:long,score:double,first_word:long,last_word:long>"


def words(texts: pa.Array) -> Words:
    """Runs of letters and digits, lower-cased."""
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    return words_of(pc.replace_substring_regex(lower, r"[^\p{L}\p{N}\x00-\x7F]+", " "), ALNUM)


@dataclass(frozen=True)
class Pairs:
    """Codes of word pairs, in order, and where items have them."""

    codes: np.ndarray
    #: The (item, start) of code k are those from first[k] to first[k + 1].
    first: np.ndarray
    item: np.ndarray
    start: np.ndarray
    #: Slots of the codes.
    bits: np.ndarray

    @staticmethod
    def of(code: np.ndarray, item: np.ndarray, start: np.ndarray) -> Pairs:
        order = np.lexsort((start, item, code))
        codes, first = np.unique(code[order], return_index=True)
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[_slots(codes)] = True
        return Pairs(codes, np.append(first, len(code)), item[order], start[order], bits)

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number in codes) of those of some codes that are among these."""
        at = np.flatnonzero(self.bits[_slots(codes)])
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        hit = self.codes[k] == codes[at]
        return at[hit], k[hit]


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Items:
    """A block of test items, as numbers of their words from 1."""

    ids: tuple[int | None, ...]
    vocabulary: dict[bytes, int]
    texts: tuple[np.ndarray, ...]
    pairs: Pairs

    def numbers(self, some: Words) -> np.ndarray:
        """The words by number; 0 for those that no item has."""
        codes, distinct = some.coded()
        known = np.fromiter(map(self.vocabulary.get, distinct.to_pylist(), repeat(0)), np.int64, len(distinct))
        return known[codes] if len(codes) else np.zeros(0, np.int64)

    def pair_codes(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, code) of each pair of known words one or two apart in one text, and of single words where an item is one."""
        text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        places, codes = [], []
        for apart in (1, 2):
            a, b = numbers[:-apart], numbers[apart:]
            at = np.flatnonzero((a > 0) & (b > 0) & (text[:-apart] == text[apart:]))
            places.append(at)
            codes.append(a[at] * (len(self.vocabulary) + 1) + b[at])
        if any(len(t) == 1 for t in self.texts):
            at = np.flatnonzero(numbers)
            places.append(at)
            codes.append(numbers[at] * (len(self.vocabulary) + 1))
        return np.concatenate(places), np.concatenate(codes)


def build_items(rows: list[tuple[int | None, str | None]]) -> Items:
    all_words = words(pa.array([t for _, t in rows], pa.string()))
    flat = all_words.flat.to_pylist()
    vocabulary = {w: k + 1 for k, w in enumerate(sorted(set(flat)))}
    numbers = np.array([vocabulary[w] for w in flat], np.int64)
    texts = tuple(numbers[a:b] for a, b in zip(all_words.bounds[:-1], all_words.bounds[1:]))
    items = Items(tuple(i for i, _ in rows), vocabulary, texts, Pairs.of(*[np.zeros(0, np.int64)] * 3))
    places, codes = items.pair_codes(numbers, all_words.bounds)
    item = np.searchsorted(all_words.bounds, places, "right") - 1
    sizes = np.diff(all_words.bounds)
    own = (codes % (len(vocabulary) + 1) > 0) | (sizes[item] == 1)  # single words are seeds of single-word items only
    return Items(items.ids, vocabulary, texts, Pairs.of(codes[own], item[own], (places - all_words.bounds[item])[own]))


@dataclass(frozen=True)
class Seeds:
    """The pairs that start alignments; by item, how many of them an alignment has at least, and the words in the text that it has at most."""

    pairs: Pairs
    need: np.ndarray
    span: np.ndarray


def choose_seeds(items: Items, n: np.ndarray, min_score: float, share: float) -> Seeds:
    """All pairs from the rarest starts of each item, `share` of its words at least; n counts each pair in the texts."""
    p = items.pairs
    k = np.repeat(np.arange(len(p.codes)), np.diff(p.first))
    sizes = np.array([len(t) for t in items.texts], np.int64)
    place = np.cumsum(sizes) - sizes
    rarity = np.bincount(place[p.item] + p.start, n[k], int(sizes.sum()) + 1) if len(k) else np.zeros(1)
    least = np.maximum(1, np.ceil(min_score * sizes - 1 - 1e-9)).astype(np.int64)
    starts = np.maximum(1, sizes - 1)
    used = np.minimum(starts, np.maximum(starts - least + 1, np.ceil(share * sizes).astype(np.int64)))
    chosen = np.zeros(len(rarity), bool)
    for i, t in enumerate(items.texts):
        if len(t):
            chosen[place[i] + np.argsort(rarity[place[i] : place[i] + starts[i]], kind="stable")[: used[i]]] = True
    own = chosen[place[p.item] + p.start]
    code = np.repeat(p.codes, np.diff(p.first))
    return Seeds(Pairs.of(code[own], p.item[own], p.start[own]), least - (starts - used), np.ceil((3 - 2 * min_score) * sizes).astype(np.int64) + 1)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last) of the best local alignment; first and last are places in the passage.

    A row of the matrix at a time: a gap within a row costs per step, so a running maximum of the
    scores, raised by what their place would cost, gives the best gap for all places at once.
    """
    width = len(passage)
    steps = np.arange(width + 1) * -GAP
    above, begun = np.zeros(width + 1, np.int64), np.arange(width + 1)
    best = (0, 0, -1)
    for w in item:
        here = np.zeros(width + 1, np.int64)
        start = np.arange(width + 1)
        diagonal = above[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = above[1:] + GAP
        here[1:] = np.maximum(np.maximum(diagonal, up), 0)
        start[1:] = np.where(here[1:] == 0, start[1:], np.where(diagonal >= up, begun[:-1], begun[1:]))
        raised = here + steps
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, np.arange(width + 1), 0))
        gapped = top - steps
        wider = gapped > here
        start = np.where(wider, start[source], start)
        here = np.where(wider, gapped, here)
        k = int(here.argmax())
        if here[k] > best[0]:
            best = (int(here[k]), int(start[k]), k - 1)
        above, begun = here, start
    return best


def candidate_windows(items: Items, seeds: Seeds, numbers: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, list[list[int]]]]:
    """By text and item the stretches (first, last + 1) of its words that hold as many seeds of the item as an alignment has, in its span."""
    places, codes = items.pair_codes(numbers, bounds)
    at, k = seeds.pairs.found(codes)
    count = np.diff(seeds.pairs.first)[k]
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    item = seeds.pairs.item[np.repeat(seeds.pairs.first[k], count) + within]
    place = np.repeat(places[at], count)
    order = np.lexsort((place, item))
    item, place = item[order], place[order]
    text = np.searchsorted(bounds, place, "right") - 1
    other = np.arange(len(item)) + seeds.need[item] - 1
    end = np.minimum(other, max(0, len(item) - 1))
    held = np.flatnonzero((other == end) & (item[end] == item) & (text[end] == text) & (place[end] - place <= seeds.span[item]))
    found: dict[int, dict[int, list[list[int]]]] = defaultdict(lambda: defaultdict(list))
    for t, i, a, b in zip(text[held].tolist(), item[held].tolist(), place[held].tolist(), place[end[held]].tolist()):
        span, windows = int(seeds.span[i]), found[t][i]
        a, b = max(int(bounds[t]), a - span), min(int(bounds[t + 1]), b + span + 1)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], b)
        else:
            windows.append([a, b])
    return found


def leaks_in(items: Items, seeds: Seeds, some: Words, min_score: float) -> dict[int, list[tuple[int | None, float, int, int]]]:
    """By text (item_id, score, first word, last word) of each item that it holds, by its best alignment, the first of equals."""
    numbers, bounds = items.numbers(some), some.bounds
    found = {}
    for text, by_item in candidate_windows(items, seeds, numbers, bounds).items():
        leaks = []
        for item, windows in by_item.items():
            best = (0.0, 0, 0)
            for a, b in windows:
                score, first, last = align(items.texts[item], numbers[a:b])
                share = score / (MATCH * len(items.texts[item]))
                if share > best[0]:
                    best = (share, a - int(bounds[text]) + first, a - int(bounds[text]) + last)
            if best[0] >= min_score:
                leaks.append((items.ids[item], *best))
        if leaks:
            found[text] = sorted(leaks, key=lambda x: (x[0] is None, x[0] or 0))
    return found


def count_pairs(rows: DataFrame, items: Items) -> np.ndarray:
    """How often the texts of rows hold each pair of the items."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        total = np.zeros(len(items.pairs.codes), np.int64)
        for batch in byte_slices(batches, 0, SLICE):
            some = words(batch.column(0))
            total += np.bincount(items.pairs.found(items.pair_codes(items.numbers(some), some.bounds)[1])[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["pair", "n"])

    shared = rows.sparkSession.sparkContext.broadcast(items)
    counts = rows.select("text").mapInArrow(released(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(items.pairs.codes), np.int64)
    n[counts.column("pair").to_numpy()] = counts.column("n").to_numpy()
    return n


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = 0.5, seed_share: float = 0.75, block_items: int = 20_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with leaks: (item_id, score, first_word, last_word) of each benchmark item that a text holds.

    Words are runs of letters and digits, lower-cased.  The score is that of the best local
    alignment, 2 for a match and -1 for any edit, over that of the whole item; from min_score on
    the item has leaked.  Every alignment that reaches it is found, for items of three words or
    more (see the module); shorter ones need one of their pairs, or their word.  Seeds are the pairs
    from the rarest seed_share of each item's words, by how often docs hold them.  The benchmark is
    joined in blocks of about block_items, each broadcast; docs never move, and are read twice for
    each block.

    Null and empty texts hold nothing; an item without words is never found; repeated items are
    found each; repeated rows each have their leaks; a column named leaks is replaced; an empty
    benchmark or table finds nothing.  Texts are searched whole.
    """
    spark = docs.sparkSession
    tests = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-tests.count() // block_items))
    rows = docs.drop("leaks")
    result = rows.withColumn("leaks", F.array().cast(f"array<{LEAK}>"))
    for b in range(blocks):
        items = build_items([(r["item_id"], r["text"]) for r in tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()])
        seeds = choose_seeds(items, count_pairs(rows.select(F.col(text_col).alias("text")), items), min_score, seed_share)
        result = _add_leaks(spark, result, items, seeds, min_score, text_col)
    return result


def _add_leaks(spark: SparkSession, rows: DataFrame, items: Items, seeds: Seeds, min_score: float, text_col: str) -> DataFrame:
    shared = spark.sparkContext.broadcast((items, seeds))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = shared.value
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
        names = ("item_id", "score", "first_word", "last_word")
        for batch in byte_slices(batches, text_col, SLICE):
            found = leaks_in(items, seeds, words(batch.column(text_col)), min_score)
            new = [old + [dict(zip(names, x)) for x in found.get(k, ())] for k, old in enumerate(batch.column("leaks").to_pylist())]
            at = batch.schema.get_field_index("leaks")
            columns = [pa.array(new, kind) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(released(search), T.StructType(rows.schema.fields))


def leak_rows(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): a row for each item that a document holds.

    A null doc_id stays null; the other cases are find_leaks's.
    """
    found = find_leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **options)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
