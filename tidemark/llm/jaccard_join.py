"""Similarity join of documents on word shingles, by signature trees.

Documents of one shingle set are a class; classes are joined.  A pair above the threshold differs
in few shingles, so if shingles are dealt into somewhat more parts than that, some part is equal in
both: classes without a way of equal parts between them can't link, and the highest nodes of the
tree, clusters, keep them apart.  Below a cluster, nodes in order of size and signature hold the
range of their members' sizes and the OR of their signatures, bitmaps whose bits count to 255; a dual
traversal drops node pairs whose largest possible overlap is too small, before any set moves.  In a
pair of leaves trees of token bitmaps, traversed in the same way, lead to the pairs of classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import marked, mixed, released, shuffle_partitions, written
from .components import components

#: A worker forgets the hashes of its words beyond this many.
MAX_KNOWN_WORDS = 120_000
#: Classes and shingles of a leaf, but for a larger class: one task compares two leaves.
BLOCK = 512
LEAF_SHINGLES = 2_000_000
#: Buckets of a signature.
BUCKETS = 256
#: Shingles of the largest set: a text can hold no more words.
LONGEST = 1 << 30
LEAF, FAN = 16, 4
NO_ID = 2**63 - 1

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text.

    Words are runs without ASCII white space, A to Z in lower case; a shorter text is one shingle,
    an empty one none.
    """
    result = []
    for text in texts:
        words = (text or "").encode().lower().split()
        if not words:
            result.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
        width = min(n, len(words))
        code = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            code = (code ^ (code >> np.uint64(29))) * _A + h[k : len(words) - width + 1 + k] * _B
        result.append(np.unique(mixed(code)))
    return result


def sliced(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set, from the sum of its members' hashes."""
    sums = np.array([mixed(s ^ _C).sum(dtype=np.uint64) for s in sets], np.uint64)
    return mixed(sums + np.array([len(s) for s in sets], np.uint64) * _A).view(np.int64)


def signature(s: np.ndarray) -> bytes:
    """How many shingles of a set fall into each bucket; 255 stands for as many or more."""
    return np.minimum(np.bincount((s >> np.uint64(24)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8).tobytes()


@dataclass(frozen=True)
class Bands:
    """Sizes in bands, such that sets above the threshold are of one band or neighbours; each band deals shingles into parts."""

    starts: np.ndarray
    parts: np.ndarray
    spare: np.ndarray
    weak: np.ndarray

    @staticmethod
    def of(percent: int, longest: int) -> Bands:
        starts = [1, 2]
        while starts[-1] <= longest * 2:
            starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
        lo, hi = np.array(starts[:-1]), np.array(starts[1:]) - 1
        differ = 2 * hi * (100 - percent) // (100 + percent)
        spare = np.where(differ > 0, 1 + differ // 16, 0)
        return Bands(np.array(starts), np.where(differ > 0, differ + 1 + spare, 0), spare, np.where(lo >= 60, 3, 2))


def part_keys(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set's number, key of a part) such that any two different sets above the threshold share a key.

    A set has a label for its band and one for the next.  Under a label, at most `differ` parts of
    two linked sets are unequal, so of differ + 1 + spare at least 1 + spare are equal.  Parts with
    fewer than `weak` shingles say little; a set with no more than `spare` of them leaves them out,
    others keep them, so that two linked sets always share a part that both keep.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    of = np.repeat(np.arange(len(sets)), sizes)
    place, content = mixed(flat ^ _B) >> np.uint64(32), mixed(flat + _A)
    band = np.searchsorted(bands.starts, np.maximum(sizes, 1), "right") - 1
    numbers, keys = [], []
    for label in (band, band + 1):
        parts = np.where(sizes > 0, bands.parts[label], 0)
        offset = np.cumsum(parts) - parts
        used = parts[of] > 0
        slot = offset[of[used]] + (place[used] % np.maximum(parts[of[used]], 1).astype(np.uint64)).astype(np.int64)
        total = int(parts.sum())
        order = np.argsort(slot, kind="stable")
        count = np.bincount(slot, minlength=total)
        sums = np.zeros(total, np.uint64)
        filled = np.flatnonzero(count)
        if len(filled):
            sums[filled] = np.add.reduceat(content[used][order], np.cumsum(count[filled]) - count[filled])
        owner = np.repeat(np.arange(len(sets)), parts)
        weak = count < bands.weak[label][owner]
        many = np.bincount(owner, weak, len(sets)) > bands.spare[label]
        keep = ~weak | many[owner]
        position = np.arange(total) - offset[owner]
        key = mixed(sums + mixed((label[owner] * 1_000_003 + position).astype(np.uint64)) + count.astype(np.uint64) * _C)
        numbers.append(owner[keep])
        keys.append(key[keep].view(np.int64))
    return np.concatenate(numbers), np.concatenate(keys)


#: Below this percentage equal parts are small and tell little: bands of minhashes take their place, unless asked otherwise.
EXACT_PERCENT = 90
BAND_ROWS, BAND_MISS = 5, 1e-10


def band_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set's number, key of a band): two sets at the threshold share none with a chance of BAND_MISS, above it with less."""
    count = int(np.ceil(np.log(BAND_MISS) / np.log1p(-((percent / 100) ** BAND_ROWS))))
    random = np.random.default_rng(80)
    turn = random.integers(0, 2**32, (count * BAND_ROWS, 1), np.uint32, endpoint=False)
    times = random.integers(0, 2**32, (count * BAND_ROWS, 1), np.uint32, endpoint=False) | np.uint32(1)
    weights = mixed(np.arange(BAND_ROWS, dtype=np.uint64)) | np.uint64(1)
    place = mixed(np.arange(count, dtype=np.uint64) + _B)
    filled = [k for k, s in enumerate(sets) if len(s)]
    keys = np.zeros((len(filled), count), np.uint64)
    for row, k in enumerate(filled):
        x = (sets[k] >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(turn), 2**32 - 1, np.uint32)
        for i in range(0, len(x), 2048):
            least = np.minimum(least, ((x[i : i + 2048] ^ turn) * times).min(1))
        keys[row] = mixed((least.reshape(count, BAND_ROWS) * weights).sum(1, dtype=np.uint64) + place)
    return np.repeat(np.array(filled, np.int64), count), keys.ravel().view(np.int64)


@dataclass(frozen=True)
class Tree:
    """Levels of nodes from the leaves up: sizes from lo to hi, OR of bitmaps, and the first member of each."""

    sizes: np.ndarray
    bits: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(sizes: np.ndarray, bits: np.ndarray) -> Tree:
        """Of members in ascending order of size."""
        levels, lo, hi, joined, fan = [], sizes, sizes, bits, LEAF
        while True:
            first = np.arange(0, len(lo), fan)
            lo, hi, joined = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.bitwise_or.reduceat(joined, first, axis=0)
            levels.append((lo, hi, joined))
            if len(lo) == 1:
                return Tree(sizes, bits, levels)
            fan = FAN


def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the largest possible overlap of node pairs can reach the threshold."""
    (alo, ahi, abits), (blo, bhi, bbits) = a, b
    overlap = np.concatenate([np.bitwise_count(abits[i[k : k + 2048]] & bbits[j[k : k + 2048]]).sum(1, dtype=np.int64) for k in range(0, len(i), 2048)] or [np.zeros(0, np.int64)])
    overlap = np.minimum(overlap, np.minimum(ahi[i], bhi[j]))
    ranges = (ahi[i] * 100 >= blo[j] * percent) & (bhi[j] * 100 >= alo[i] * percent)
    return ranges & (overlap * (100 + percent) >= (alo[i] + blo[j]) * percent)


def traverse(a: Tree, b: Tree, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of members of a and b, each once; if they are the same tree, of different members."""
    height = max(len(a.levels), len(b.levels))
    i = j = np.zeros(1, np.int64)
    for level in range(height - 1, -1, -1):
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        keep = may_link(a.levels[la], i, b.levels[lb], j, percent)
        i, j = i[keep], j[keep]
        if level:
            steps = [(x, y) for x in range(FAN if la == level else 1) for y in range(FAN if lb == level else 1)]
            ci = np.concatenate([i * (FAN if la == level else 1) + x for x, _ in steps])
            cj = np.concatenate([j * (FAN if lb == level else 1) + y for _, y in steps])
            na, nb = len(a.levels[min(level - 1, len(a.levels) - 1)][0]), len(b.levels[min(level - 1, len(b.levels) - 1)][0])
            ok = (ci < na) & (cj < nb) & ((ci <= cj) | (not same))
            i, j = ci[ok], cj[ok]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in zip(i * LEAF, j * LEAF):
        xs, ys = slice(x, x + LEAF), slice(y, y + LEAF)
        overlap = np.bitwise_count(a.bits[xs][:, None] & b.bits[ys][None]).sum(2, dtype=np.int64)
        linked = overlap * 100 >= (a.sizes[xs][:, None] + b.sizes[ys][None] - overlap) * percent
        p, q = np.nonzero(linked)
        p, q = p + x, q + y
        if same:
            p, q = p[p < q], q[p < q]
        left.append(p)
        right.append(q)
    return np.concatenate(left), np.concatenate(right)


def may_meet(node: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the largest possible overlap of members of nodes i and j, by their signatures and sizes, can reach the threshold."""
    lo, hi, counts = node
    shared = [np.zeros(0, np.int64)]
    for k in range(0, len(i), 4096):
        least = np.minimum(counts[i[k : k + 4096]], counts[j[k : k + 4096]])
        shared.append(np.where((least == 255).any(1), LONGEST, least.sum(1, dtype=np.int64)))
    overlap = np.minimum(np.concatenate(shared), np.minimum(hi[i], hi[j]))
    ranges = (hi[i] * 100 >= lo[j] * percent) & (hi[j] * 100 >= lo[i] * percent)
    return ranges & (overlap * (100 + percent) >= (lo[i] + lo[j]) * percent)


def leaf_pairs(lo: np.ndarray, hi: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves, each once and with itself, that may hold a link: by dual traversal of the nodes above them."""
    levels = [(lo, hi, counts)]
    while len(levels[-1][0]) > 1:
        x, y, c = levels[-1]
        first = np.arange(0, len(x), FAN)
        levels.append((np.minimum.reduceat(x, first), np.maximum.reduceat(y, first), np.maximum.reduceat(c, first, axis=0)))
    i = j = np.zeros(1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        keep = may_meet(levels[level], i, j, percent)
        i, j = i[keep], j[keep]
        if level:
            n = len(levels[level - 1][0])
            x, y = (v.ravel() for v in np.meshgrid(np.arange(FAN), np.arange(FAN)))
            i, j = (i[:, None] * FAN + x).ravel(), (j[:, None] * FAN + y).ravel()
            ok = (i <= j) & (j < n)
            i, j = i[ok], j[ok]
    return i, j


def leaves(block: int):
    """Cuts (cluster, n, signature, cls, doc_id, copies), in this order, into leaves, and sums each up.

    Rows come back with the number of their leaf; a row with hi, the sum, ends each leaf: n is its
    smallest size, and copies the count of its classes.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 40, None
        names = ["cluster", "n", "signature", "cls", "doc_id", "copies", "leaf", "hi"]

        def ended(rows: pa.RecordBatch, leaf: int) -> pa.RecordBatch:
            n, k = rows.column(1).to_numpy(), rows.num_rows
            most = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(k, BUCKETS).max(0).tobytes()
            columns = [[rows.column(0)[0].as_py()], [int(n.min())], [most], [None], [None], [k], [leaf], [int(n.max())]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            node = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
            columns = [*rows.columns[:2], pa.nulls(k, pa.binary()), *rows.columns[3:], pa.array(np.full(k, leaf)), pa.nulls(k, pa.int64())]
            return pa.concat_batches([pa.RecordBatch.from_arrays(columns, names=names), node])

        for batch in batches:
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            if not rows.num_rows:
                continue
            cluster, first, shingles = rows.column(0).to_numpy(), 0, np.cumsum(rows.column(1).to_numpy())
            ends = np.append(np.flatnonzero(np.diff(cluster)) + 1, rows.num_rows)
            for end in ends:
                while first < end:
                    full = int(np.searchsorted(shingles, (shingles[first - 1] if first else 0) + LEAF_SHINGLES, "right"))
                    last = min(end, first + block, max(full, first + 1))
                    if last == rows.num_rows:  # it may go on in the next batch
                        break
                    yield ended(rows.slice(first, last - first), number)
                    number, first = number + 1, last
            held = rows.slice(first) if first < rows.num_rows else None
        if held is not None:
            yield ended(held, number)

    return cut


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each token that two sets or more hold: the AND of two rows counts their overlap."""
    tokens, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bit = np.cumsum(n > 1) - 1
    shared = n[at] > 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[shared]
    column = bit[at[shared]]
    bits = np.zeros((len(sets), max(1, -(-(int((n > 1).sum())) // 64)) * 8), np.uint8)
    np.bitwise_or.at(bits, (row, column >> 3), np.left_shift(1, column & 7).astype(np.uint8))
    return bits.view(np.uint64)


def link_group(group: pd.DataFrame, same: bool, percent: int) -> pd.DataFrame:
    """(cls, root, links): the links of each class within a leaf, or between two, and the smallest class they reach."""
    group = group.sort_values(["n", "cls"], kind="stable").reset_index(drop=True)
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    sizes, bits = group["n"].to_numpy(np.int64), bitmaps(sets)
    if same:
        tree = Tree.of(sizes, bits)
        left, right = traverse(tree, tree, True, percent)
    else:
        one, two = (np.flatnonzero(group["leaf"] == b) for b in (group["lo"][0], group["hi"][0]))
        if not len(one) or not len(two):
            return pd.DataFrame({"cls": [], "root": [], "links": []}, dtype="int64")
        left, right = traverse(Tree.of(sizes[one], bits[one]), Tree.of(sizes[two], bits[two]), False, percent)
        left, right = one[left], two[right]
    copies, cls = group["copies"].to_numpy(np.int64), group["cls"].to_numpy(np.int64)
    links = np.bincount(left, copies[right], len(group)) + np.bincount(right, copies[left], len(group))
    root = cls.copy()
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        if (new == root).all():
            break
        root = new
    linked = links > 0
    return pd.DataFrame({"cls": cls[linked], "root": root[linked], "links": links[linked].astype(np.int64)})


def join_documents(docs: DataFrame, n: int = 3, percent: int = 90, block: int = BLOCK, exact: bool | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row for each row of docs.

    Two documents link when 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest doc_id that links reach; n_links counts the rows linked with it.

    Null and empty texts have no shingles and no links; copies of a text, and repeated rows, link
    with each other; a null doc_id counts as larger than all others, and stays null; other columns
    are left out; an empty table gives no rows.

    With exact, which is the default from EXACT_PERCENT on, no pair is lost: what can link shares an
    equal part.  Below, parts hold few shingles, so that a passage which many texts share makes one
    cluster of them all; without exact, bands of minhashes gather the clusters, and a pair is lost
    with a chance of BAND_MISS at most.  Either way a link is decided on whole sets.

    Copies become one class before texts are compared, and equal parts combine within a batch
    before they are shuffled, so neither moves a hot group whole.  Sets are sent once for each
    pair of leaves that the traversal leaves over: in a group of n different near copies all of
    (n / block) ** 2 / 2.  A cluster's leaves, a row each, are traversed in one task.
    """
    members, per_class = _joined_classes(docs, n, percent, block, exact, id_col, text_col)
    joined = members.select("doc_id", "cls", "n").join(per_class, "cls", "left")
    real = lambda c: F.when(c != NO_ID, c)
    return joined.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """What tells a row from others in verdicts: its id, NO_ID if null, and the hash of its text, 42 if null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text_col)


def verdicts(docs: DataFrame, n: int = 3, percent: int = 90, block: int = BLOCK, exact: bool | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, stays): by row_key, whether a row is the one of its group that stays.

    A group is what links reach, row by row: rows of one doc_id with different texts may be in
    different groups.  The one with the smallest doc_id stays, null last, and of those with the
    smallest text_key; rows that repeat both are one.  Rows that are linked with nothing and
    repeated by none aren't listed: they stay.  The other cases are join_documents's.
    """
    members, per_class = _joined_classes(docs, n, percent, block, exact, id_col, text_col)
    distinct = members.groupBy("doc_id", "text_key", "cls").agg(F.count("*").alias("copies"))
    linked = written(distinct.join(per_class.filter("n_links > 0").select("cls", "root"), "cls", "left").filter("root is not null or copies > 1").select("doc_id", "text_key", "root"), "linked")
    first = linked.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    judged = linked.select("doc_id", "text_key", F.col("root").isNull().alias("stays")).unionByName(first.withColumn("stays", F.lit(True)))
    return judged.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"))


def _joined_classes(docs: DataFrame, n: int, percent: int, block: int, exact: bool | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, cls, n, signature) of each row, cls null without words, and (cls, root, component_id, n_links) of each class; written tables."""
    exact = percent >= EXACT_PERCENT if exact is None else exact
    bands = Bands.of(percent, LONGEST)
    doc_id, text_key = row_key(id_col, text_col)
    rows = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), text_key.alias("text_key"))

    def classify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1000):
            sets = shingle_sets(part.column(1).to_pylist(), n)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(class_ids(sets) if len(sets) else sizes, mask=sizes == 0), pa.array(sizes), pa.array(map(signature, sets), pa.binary())], names=["doc_id", "text_key", "cls", "n", "signature"])

    members = written(rows.mapInArrow(released(classify), "doc_id long, text_key long, cls long, n long, signature binary"), "members")
    one = F.min_by(F.struct("n", "signature"), "doc_id").alias("one")
    classes = written(members.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), one).select("cls", "doc_id", "copies", "one.*"), "classes")

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, cls) of the parts; of equal keys in a batch the smallest class, and edges (cls, head) of the others to it."""
        for batch in sliced(batches, 4000):
            owner, keys = [], []
            seen: set[int] = set()
            for i in range(0, batch.num_rows, 500):
                sets = shingle_sets(batch.column(0).slice(i, 500).to_pylist(), n)
                ids = class_ids(sets) if sets else np.zeros(0, np.int64)
                new = [k for k, c in enumerate(ids.tolist()) if len(sets[k]) and not (c in seen or seen.add(c))]
                some = [sets[k] for k in new]
                number, key = part_keys(some, bands) if exact else band_keys(some, percent)
                owner.append(ids[new][number] if new else np.zeros(0, np.int64))
                keys.append(key)
            cls, key = np.concatenate([*owner, np.zeros(0, np.int64)]), np.concatenate([*keys, np.zeros(0, np.int64)])
            order = np.lexsort((cls, key))
            cls, key = cls[order], key[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            head = cls[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else cls
            edges = np.unique(np.stack([cls[~first], head[~first]], 1), axis=0)
            own = mixed((edges[:, 0] * 3 + edges[:, 1]).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[first], own])), pa.array(np.concatenate([cls[first], edges[:, 0]])), pa.array(np.concatenate([cls[first], edges[:, 1]]), mask=np.concatenate([np.ones(first.sum(), bool), np.zeros(len(edges), bool)]))],
                names=["key", "cls", "head"],
            )

    dealt = rows.select("text").mapInArrow(released(deal), "key long, cls long, head long")
    smallest = F.first("cls").over(W.partitionBy("key").orderBy("cls").rowsBetween(W.unboundedPreceding, 0))
    edges = dealt.withColumn("first", smallest).select(F.explode(F.array(F.struct(F.col("cls").alias("a"), F.col("head").alias("b")), F.struct(F.col("cls").alias("a"), F.when(F.col("head").isNull(), F.col("first")).alias("b")))).alias("e")).select("e.*").filter("b is not null and a <> b")
    coarse = components(edges)
    clusters = coarse.select(F.col("node").alias("cls"), F.col("root").alias("cluster")).union(coarse.select(F.col("root").alias("cls"), F.col("root").alias("cluster")).distinct())
    order = ["cluster", "n", "signature", "cls"]
    in_cluster = written(clusters.join(classes, "cls").select(*order, "doc_id", "copies"), "clusters")
    ordered = in_cluster.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    tree = written(ordered.mapInArrow(leaves(block), "cluster long, n long, signature binary, cls long, doc_id long, copies long, leaf long, hi long"), "tree")

    def traversed(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by([("n", "ascending"), ("leaf", "ascending")])
        lo, hi, leaf = (nodes.column(c).to_numpy() for c in ("n", "hi", "leaf"))
        counts = np.frombuffer(b"".join(nodes.column("signature").to_pylist()), np.uint8).reshape(len(lo), BUCKETS)
        i, j = leaf_pairs(lo, hi, counts, percent)
        some = (i != j) | (nodes.column("copies").to_numpy()[i] > 1)
        return pa.table({"lo": np.minimum(leaf[i], leaf[j])[some], "hi": np.maximum(leaf[i], leaf[j])[some]})

    pairs = tree.filter("hi is not null").select("cluster", "n", "hi", "leaf", "signature", "copies").groupBy("cluster").applyInArrow(traversed, "lo long, hi long")
    pairs = written(pairs, "leaf-pairs")
    ends = pairs.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("leaf"), F.struct("lo", "hi").alias("pair")).groupBy("leaf").agg(F.collect_list("pair").alias("pairs"))
    wanted = written(tree.filter("hi is null").select("cls", "n", "copies", "doc_id", "leaf").join(ends, "leaf"), "tree-members")

    def gather(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = shingle_sets(f["text"].tolist(), n)
            right = class_ids(sets) == f["cls"].to_numpy() if len(f) else np.zeros(0, bool)
            yield f.drop(columns=["text"]).assign(shingles=[s.tobytes() for s in sets])[right]

    texts = marked(rows.select("doc_id", "text"), wanted, "doc_id").join(wanted, "doc_id").select("cls", "n", "copies", "leaf", "pairs", "text")
    sets = texts.mapInPandas(gather, "cls long, n long, copies long, leaf long, pairs array<struct<lo:long,hi:long>>, shingles binary")
    paired = sets.withColumn("pair", F.explode("pairs")).select("pair.*", "leaf", "cls", "n", "copies", "shingles")

    def link(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = ["lo", "hi"]
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            group = pd.concat(held, ignore_index=True).drop_duplicates("cls")
            return link_group(group, bool(group["lo"].iat[0] == group["hi"].iat[0]), percent)

        for f in frames:
            for k, part in f.groupby(key, sort=False):
                if held and tuple(held[0][key].iloc[0]) != k:
                    yield done()
                    held = []
                held.append(part)
        if held:
            yield done()

    together = paired.repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    linked = written(together.mapInPandas(link, "cls long, root long, links long"), "links")
    final = components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cls"), "root")
    links = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    rooted = classes.join(final, "cls", "left").join(links, "cls", "left").select("cls", "doc_id", "copies", F.coalesce("root", "cls").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    per_class = written(rooted.join(lowest, "root").select("cls", "root", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "class-components")
    return members, per_class
