"""Token counts by byte-pair merging without identifiers.

A text is cut into the pieces of the byte-level pre-tokenizer.  Within a piece a heap yields the
adjacent pair of the lowest rank, a linked list joins its two symbols, and the count of tokens is
the number of initial symbols minus the number of merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: The pre-tokenizer pattern of byte-level vocabularies.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A worker forgets its piece counts beyond this many; they are then counted anew.
MAX_KNOWN_PIECES = 1_000_000
#: Bytes of text that a worker has as strings at a time, but for a longer text.
SLICE = 1 << 24

_counters: dict[str, TextCounter] = {}


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself if printable in Latin-1, else the next code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(spare)
            spare += 1
    return [symbols[b] for b in range(256)]


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the adjacent pair of the lowest rank, the leftmost of equals, is merged again and again."""
    n = len(symbols)
    symbol: list[str | None] = list(symbols)
    following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = following[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue  # an earlier merge took one of the two
        symbol[i], symbol[j] = a + b, None
        following[i] = after = following[j]
        left -= 1
        if after < n:
            preceding[after] = i
            if (rank := ranks.get((a + b, symbol[after]))) is not None:
                heapq.heappush(heap, (rank, i, a + b, symbol[after]))
        if (before := preceding[i]) >= 0 and (rank := ranks.get((symbol[before], a + b))) is not None:
            heapq.heappush(heap, (rank, before, symbol[before], a + b))
    return left


class PieceCounts(dict):
    """Token counts of pieces, counted when first asked for."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks, self.symbols = ranks, byte_symbols()

    def __missing__(self, piece: str) -> int:
        count = merged_count([self.symbols[b] for b in piece.encode()], self.ranks)
        if len(self) >= MAX_KNOWN_PIECES:
            self.clear()
        self[piece] = count
        return count


class TextCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.counts = PieceCounts({(a, b): rank for rank, (a, b) in enumerate(pairs)})
        self.pieces = regex.compile(PIECE)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def __call__(self, text: str) -> int:
        """Strings of special tokens inside a text are one token each, as in the library."""
        parts = self.specials.split(text) if self.specials else [text]
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.pieces.findall(part))) for part in parts)


def text_counter(path: str) -> TextCounter:
    """One per worker process, kept across its tasks."""
    if path not in _counters:
        _counters[path] = TextCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs, in one pass without a shuffle.

    tokenizer: path of a byte-level byte-pair .json file, present on all workers.  Null and empty
    texts have 0 bytes and tokens; repeated rows and null ids stay; other columns are left out; an
    empty table gives no rows.  A text is counted whole, however long, in O(n log n) of its longest piece.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = text_counter(tokenizer)
        for batch in byte_slices(batches, 1, SLICE):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [counter(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
