"""Token ids in byte-aligned variable-length coding, with the control bytes apart from the data.

Ids are ranked by their frequency in the corpus; a rank takes 1 to 4 bytes.  Four two-bit lengths
make a control byte.  Blocks of whole documents, in ascending doc_id order, are rows of a Parquet
table in the shared folder: control bytes in one column, data bytes in another.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_slices, checked_broadcast, released, shuffle_partitions, written
from .token_counts import byte_symbols

END_ID = 1
#: Ids in a block, but for a longer document.
BLOCK_IDS = 65_536
#: A worker holds about this many words, 0.2 MB a thousand, and forgets those that came longest ago; the library then encodes them anew.
MAX_KNOWN_WORDS = 900_000
#: Bytes of text that a worker encodes at a time for each word it may hold, but for a longer text.
BYTES_PER_WORD = 20
#: Parts words in one call; a word that holds it is encoded alone.
MARK = "\x02"
#: What the added tokens of a vocabulary, which have their own case, begin with.
ADDED = "<|"
#: Letters whose lower case is one code point, and composed.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
BLOCK_SCHEMA = "part int, block int, doc_ids binary, lengths binary, n_ids long, control binary, data binary"

#: For each control byte: the lengths of its four values, and their sum.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.int64)

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts by their words, each of which the library encodes once.

    Valid for tokenizers that drop white space, never merge across it or between a letter and
    a stop or comma behind it, map letters to lower case, and code words by their bytes.
    """

    def __init__(self, path: str, known_words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        from tokenizers import Tokenizer

        self.limit = known_words
        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {"": b""}, {}
        self.model, self.symbols = self.tokenizer.model, {b: s for b, s in enumerate(byte_symbols()) if b != ord(s)}
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def learn(self, words: list[str]) -> None:
        """One call for many words; a mark between them, a piece of its own, tells whose the tokens are."""
        ids = np.array(self.tokenizer.encode(f" {MARK} ".join(words), add_special_tokens=False).ids, self.kind)
        ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
        raw, width, begin = ids.tobytes(), ids.itemsize, 0
        for word, end in zip(words, ends, strict=True):
            self.known[word] = raw[begin * width : end * width]
            begin = end + 1

    def learn_letters(self, words: list[str]) -> None:
        """Words of Latin letters alone are one piece each, which the model codes without the steps before it."""
        code = self.model.tokenize
        coded = [[t.id for t in code(w if w.isascii() else w.encode().decode("latin-1").translate(self.symbols))] for w in map(str.lower, words)]
        width = np.dtype(self.kind).itemsize
        ends = (np.cumsum([len(c) for c in coded]) * width).tolist()
        raw, begin = np.array([i for c in coded for i in c], self.kind).tobytes(), 0
        for word, end in zip(words, ends):
            self.known[word] = raw[begin:end]
            begin = end

    def learn_all(self, new: list[str]) -> None:
        """A stop or comma behind a letter at the end of a word is a piece of its own, so that only the rest is encoded."""
        stopped = [w for w in new if w[-1] in ".," and LETTERS.match(w, len(w) - 2)]
        plain = set(new).difference(stopped).union(w[:-1] for w in stopped).union(w[-1] for w in stopped).difference(self.known)
        letters = [w for w in plain if LETTERS.fullmatch(w)]
        other = list(plain.difference(letters))
        for i in range(0, len(letters), 65_536):
            self.learn_letters(letters[i : i + 65_536])
        for w in other:
            if MARK in w:
                self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
        other = [w for w in other if MARK not in w]
        for i in range(0, len(other), 4096):
            self.learn(other[i : i + 4096])
        for w in stopped:
            self.known[w] = self.known[w[:-1]] + self.known[w[-1]]

    def words_of(self, texts: pa.Array) -> pa.Array:
        """Texts in lower case (A to Z), cut at blanks and line ends; one that may hold an added token keeps its case."""
        texts = pc.fill_null(texts, "")
        lower, marked = pc.ascii_lower(texts), pc.match_substring(texts, ADDED)
        if pc.any(marked).as_py():
            lower = pc.if_else(marked, texts, lower)
        return pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, one after the other; how many each has)."""
        split = self.words_of(texts)
        coded = split.flatten().dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > self.limit // 2:  # words that haven't come since the last time are forgotten
            self.known, self.older = {"": b""}, self.known
        new = [w for w in words if w not in self.known]
        seen = [w for w in new if w in self.older]
        self.known.update((w, self.older[w]) for w in seen)
        self.learn_all(new if not seen else [w for w in new if w not in self.known])
        values = list(map(self.known.__getitem__, words))
        width = np.dtype(self.kind).itemsize
        flat, sizes = np.frombuffer(b"".join(values), self.kind), np.fromiter(map(len, values), np.int64, len(values)) // width
        tokens = sizes[place]
        ends = np.cumsum(tokens)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[place] - (ends - tokens), tokens) + np.arange(int(tokens.sum()))]
        last_word = np.cumsum(pc.list_value_length(split).to_numpy())
        lengths = np.diff(np.append(0, ends)[np.append(0, last_word)]) + 1
        result, own = np.full(len(ids) + len(texts), end_id, self.kind), np.ones(len(ids) + len(texts), bool)
        own[np.cumsum(lengths) - 1] = False
        result[own] = ids
        return result, lengths


def word_encoder(path: str, known_words: int = MAX_KNOWN_WORDS) -> WordEncoder:
    """One per worker process, kept across its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, known_words)
    _encoders[path].limit = known_words
    return _encoders[path]


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data): each value in the fewest bytes, little-endian; the last control byte is padded with lengths of 1."""
    values = values.astype("<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    raw = values.view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4, dtype=np.uint8) < lengths[:, None]]
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    codes = codes.reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by table lookup of the lengths of each control byte."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + bytes(4), np.uint8)
    values = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = lengths > k
        if not longer.any():
            break
        values[longer] |= padded[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, known_words: int = MAX_KNOWN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids, id): each text's ids and the end id, in a binary as little-endian integers of the encoder's kind.

    Rows with an id, and nothing else but n, hold how often a task has met it.
    """
    width = np.dtype(word_encoder(tokenizer).kind).itemsize
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("id", pa.int64())])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = word_encoder(tokenizer, known_words), np.zeros(1 << 16, np.int64)
        for part in byte_slices(batches, 1, known_words * BYTES_PER_WORD):
            ids, lengths = encoder(part.column(1), end_id)
            if ids.nbytes >= 1 << 31:
                raise ValueError(f"{ids.nbytes} bytes of ids don't fit a value")
            seen = np.bincount(ids, minlength=len(total))
            seen[: len(total)] += total
            total = seen
            offsets = (np.append(0, np.cumsum(lengths)) * width).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), packed, pa.nulls(len(lengths), pa.int64())], schema=schema)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.array(total[used]), pa.nulls(len(used), pa.binary()), pa.array(used, pa.int64())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(encode), "doc_id long, n long, ids binary, id long")


def id_ranks(encoded: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first, ties by id.  At most the vocabulary's size."""
    counts = encoded.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = counts.column("id").to_numpy(), counts.column("n").to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


def write_blocks(encoded: DataFrame, by_rank: np.ndarray, kind: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the blocks in ascending doc_id order, null first, and returns the table as read back."""
    spark = encoded.sparkSession
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)  # at most the vocabulary

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("n_ids", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, part, number, width = ranks.value, TaskContext.get().partitionId(), 0, np.dtype(kind).itemsize
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = batch.column(1)
            ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) // width
            ids, lengths = np.frombuffer(packed.buffers()[2], kind)[ends[0] : ends[-1]], np.diff(ends)
            ends = np.cumsum(lengths)
            doc_ids = pc.fill_null(batch.column(0), np.iinfo(np.int64).min).to_numpy().astype("<i8")
            begins = np.flatnonzero(np.diff((ends - lengths) // block_ids, prepend=-1))  # whole documents
            for first, last in zip(begins, np.append(begins[1:], len(lengths))):
                some = ids[ends[first] - lengths[first] : ends[last - 1]]
                control, data = encode_values(rank[some])
                row = [part, number, doc_ids[first:last].tobytes(), lengths[first:last].astype("<i8").tobytes(), len(some), control, data]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
                number += 1

    ordered = encoded.filter("id is null").select("doc_id", "ids").repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    return written(ordered.mapInArrow(blocks, BLOCK_SCHEMA), "token-blocks")


def read_blocks(table: DataFrame, by_rank: np.ndarray, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of a written table; start counts the ids of all before it.

    With digest, ids_crc32 stands in place of ids, which are little-endian uint32.
    """
    ids_of = table.sparkSession.sparkContext.broadcast(by_rank)
    # a row per block, then per part: as many as partitions wrote
    in_part = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = table.select("part", "block", "n_ids")
    blocks = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).select("part", "block", "in_part")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = written(blocks.join(parts, "part").select("part", "block", (F.col("before") + F.col("in_part")).alias("start")), "token-starts")
    located = table.join(checked_broadcast(starts), ["part", "block"]).select("start", "doc_ids", "lengths", "n_ids", "control", "data")

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of_rank = ids_of.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = ids_of_rank[decode_values(row["control"], row["data"], row["n_ids"])]
                doc_ids, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                each = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, lengths)]
                values = pa.array(map(zlib.crc32, each), pa.int64()) if digest else pa.array(each, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == np.iinfo(np.int64).min), pa.array(row["start"] + ends - lengths), pa.array(lengths), values], names=["doc_id", "start", "n_tokens", last])

    last = "ids_crc32" if digest else "ids"
    return located.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {last} {'long' if digest else 'binary'}")


def write_token_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, known_words: int = MAX_KNOWN_WORDS) -> tuple[DataFrame, np.ndarray]:
    """(table of blocks, ids by rank) of all rows of docs.

    Null and empty texts are the end id alone; repeated rows are written each, next to each other;
    a null doc_id comes first; other columns are left out; an empty table writes no blocks.  A text
    longer than a block has a block of its own; one whose ids take 2 GB, which no value can hold, is
    an error.  Strings of added tokens count as in the library: in their own case only.
    """
    encoded = written(encode_documents(docs, tokenizer, end_id, known_words), "token-ids")
    kind = word_encoder(tokenizer).kind
    by_rank = id_ranks(encoded)
    return write_blocks(encoded, by_rank, kind, block_ids), by_rank


def token_id_digests(docs: DataFrame, tokenizer: str, known_words: int = MAX_KNOWN_WORDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), from the blocks as read back."""
    table, by_rank = write_token_ids(docs, tokenizer, known_words=known_words)
    return read_blocks(table, by_rank, digest=True)
