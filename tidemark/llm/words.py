"""Words of whole Arrow columns as bytes, without a Python object for each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 0x20


def byte_map(separators: str, lower: bool) -> bytes:
    """A translation of bytes: separators to a space and, if lower, A-Z to a-z.

    separators are ASCII characters, so that bytes within longer UTF-8 sequences stay.
    """
    table = bytearray(range(256))
    if lower:
        table[0x41:0x5B] = bytes(range(0x61, 0x7B))
    for c in separators:
        table[ord(c)] = SPACE
    return bytes(table)


#: Words are what ASCII white space leaves.
BLANK = byte_map("\t\n\v\f\r ", lower=False)
#: Terms are letters and digits of ASCII, lower-cased, and everything beyond ASCII.
ALNUM = byte_map("".join(c for c in map(chr, range(128)) if not c.isalnum()), lower=True)


@dataclass(frozen=True)
class Words:
    """The words of some texts, one text after the other."""

    #: All words, as one binary array.
    flat: pa.LargeBinaryArray
    #: Words before each text, and of all texts: one more than there are texts.
    bounds: np.ndarray

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(index of each word in the distinct words, the distinct words in order of appearance)."""
        coded = self.flat.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def words_of(texts: pa.Array, mapping: bytes) -> Words:
    """The words of each text (null: none) after its bytes are mapped, cut at spaces and at the ends of texts."""
    column = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = bytes(memoryview(data)[ends[0] : ends[-1]]) if data is not None else b""
    ends = ends - ends[0]
    letters = np.frombuffer(raw.translate(mapping), np.uint8)
    inside = letters != SPACE
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = ends[:-1][ends[:-1] < len(letters)]
    begins[starts] = inside[starts]
    first = np.flatnonzero(begins)
    lengths = np.add.reduceat(inside.view(np.uint8), first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters[inside])])
    return Words(flat, np.searchsorted(first, ends))
