"""Ranked lexical search: term-at-a-time over an inverted index in segments, with limited accumulators.

Within a segment a query's terms come rarest first.  Once what the remaining terms can add is less
than the kth partial score, no document without an accumulator can be among the k best, so
no more are made; those that exist go on to exact scores.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, released, written
from .words import ALNUM, words_of

#: Bytes of text in a segment of the index, but for a longer text.
SLICE = 1 << 24
#: Bits of the filter of query terms: 1 MB, whatever their number.
FILTER_BITS = 1 << 23
#: Terms of queries, with repeats, that are sent to the workers at a time.
BLOCK_TERMS = 200_000

SEGMENT = "n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<binary>, ends array<int>, docs binary, counts binary"


def _slot(term: bytes) -> int:
    return zlib.crc32(term) & (FILTER_BITS - 1)


def packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<i4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i4").astype(np.int64)


def term_filter(queries: DataFrame, text_col: str) -> bytes:
    """A bitmap of the slots of all terms of the queries, for an index that needn't hold other terms."""

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 0, SLICE):
            found = {_slot(t) for t in words_of(batch.column(0), ALNUM).coded()[1].to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["slot"])

    found = queries.select(text_col).mapInArrow(slots, "slot long").distinct().toArrow().column("slot").to_numpy()  # FILTER_BITS at most
    bits = np.zeros(FILTER_BITS, bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


def index_documents(docs: DataFrame, only: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of docs, a row for each segment of some 16 MB of text.

    A segment has n_docs and n_terms (documents with a term, and their terms with repeats), the ids
    and lengths of the documents that a posting leads to, and by term the ordinals of its
    documents and its counts there, up to the term's end, as little-endian 32-bit integers packed by
    zstd: a batch of rows, which Arrow bounds by their number alone, is no larger than its file.  only, a
    term_filter, leaves terms out that no query has.  Rows don't move.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(only)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared.value is None else np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for batch in byte_slices(batches, 1, SLICE):
            words = words_of(batch.column(1), ALNUM)
            codes, distinct = words.coded()
            terms = distinct.to_pylist()
            sizes = np.diff(words.bounds)
            use = np.ones(len(terms), bool) if bits is None else bits[np.fromiter(map(_slot, terms), np.int64, len(terms))]
            number = np.where(use, np.cumsum(use) - 1, -1)
            term = number[codes] if len(codes) else np.zeros(0, np.int64)
            held = np.flatnonzero(term >= 0)
            doc = np.searchsorted(words.bounds, held, "right") - 1
            posting, count = np.unique(term[held] * np.int64(len(sizes)) + doc, return_counts=True)
            used, ordinal = np.unique(posting % max(1, len(sizes)), return_inverse=True)
            ends = np.searchsorted(posting, np.arange(1, int(use.sum()) + 1) * len(sizes))
            row = (
                [int((sizes > 0).sum())], [int(sizes.sum())], [batch.column(0).take(pa.array(used)).to_pylist()], [sizes[used].tolist()], [[t for t, u in zip(terms, use) if u]],
                [ends.tolist()], [packed(ordinal)], [packed(count)],
            )
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["n_docs", "n_terms", "doc_ids", "lengths", "terms", "ends", "docs", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(build), SEGMENT)


@dataclass(frozen=True)
class Block:
    """Some queries: their terms as numbers, and each query's terms, rarest first, with repeats counted."""

    terms: dict[bytes, int]
    weights: np.ndarray
    queries: list[tuple[int, np.ndarray, np.ndarray]]
    #: A score that k documents of each query reach, for all that is known.
    floors: dict[int, int]
    n_docs: int
    n_terms: int


def length_factor(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 25 + 25 * lengths * n_docs // max(1, n_terms)


def best_of_segment(impacts: list[tuple[np.ndarray, np.ndarray, int]], repeats: np.ndarray, n: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(ordinals, scores) of the documents whose score is above 0, among the k best of n and not below floor, ties of the kth included.

    impacts: (documents, what the term adds, the most of it) by term, rarest first.
    """
    scores, held = np.zeros(n, np.int64), np.zeros(n, bool)
    remaining = int(sum(most * int(r) for (_, _, most), r in zip(impacts, repeats)))
    creating = True
    for (docs, adds, most), r in zip(impacts, repeats):
        if creating:
            bound = floor
            partial = scores[held]
            if len(partial) >= k:
                bound = max(bound, int(np.partition(partial, len(partial) - k)[-k]))
            creating = remaining >= bound
        if creating:
            held[docs] = True
            scores[docs] += adds * r
        else:
            survives = held[docs]
            scores[docs[survives]] += adds[survives] * r
        remaining -= most * int(r)
    found = np.flatnonzero(held & (scores >= max(1, floor)))
    if len(found) > k:
        found = found[scores[found] >= np.partition(scores[found], len(found) - k)[-k]]
    return found, scores[found]


def _search_segments(segments: DataFrame, block: Block, k: int) -> DataFrame:
    """(query, doc_id, score) of each segment's candidates."""
    shared = segments.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("doc_ids", "lengths", "terms", "ends", "docs", "counts")}
                ids, lengths = row["doc_ids"].values, row["lengths"].values.to_numpy()
                docs, counts = (unpacked(row[c].as_py()) for c in ("docs", "counts"))
                factor = length_factor(lengths, block.n_docs, block.n_terms)
                postings: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
                begin = 0
                for term, end in zip(row["terms"].as_py(), row["ends"].as_py()):
                    t = block.terms.get(term)
                    if t is not None and block.weights[t]:
                        at, tf = docs[begin:end], counts[begin:end]
                        adds = block.weights[t] * (1_000_000_000 * tf // (1000 * tf + 12 * factor[at]))
                        postings[t] = at, adds, int(adds.max())
                    begin = end
                order = np.array([np.iinfo(np.int64).max if x is None else x for x in ids.to_pylist()], np.int64)
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                for query, terms, repeats in block.queries:
                    here = [j for j, t in enumerate(terms.tolist()) if t in postings]
                    found, scores = best_of_segment([postings[t] for t in terms[here].tolist()], repeats[here], len(order), k, block.floors.get(query, 0))
                    best = np.lexsort((order[found], -scores))[:k]
                    out.append((query, found[best], scores[best]))
                places = np.concatenate([f for _, f, _ in out]) if out else np.zeros(0, np.int64)
                columns = [pa.array(np.repeat([q for q, _, _ in out], [len(f) for _, f, _ in out]).astype(np.int64)), ids.take(pa.array(places)), pa.array(np.concatenate([s for _, _, s in out]) if out else places)]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return segments.mapInArrow(released(search), "query long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _query_terms(queries: DataFrame, segments: DataFrame, n_docs: int) -> DataFrame:
    """(query, term, repeats, df, weight) of each query's distinct terms that a document has."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1, SLICE):
            words = words_of(batch.column(1), ALNUM)
            query = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(words.bounds))))
            yield pa.RecordBatch.from_arrays([query, words.flat.cast(pa.binary())], names=["query", "term"])

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends = batch.column(1)[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(np.diff(ends, prepend=0).astype(np.int64))], names=["term", "n"])

    asked = queries.select("query", "text").mapInArrow(split, "query long, term binary").groupBy("query", "term").agg(F.count("*").alias("repeats"))
    df = segments.select("terms", "ends").mapInArrow(frequencies, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return asked.join(df, "term").select("query", "term", "repeats", "df", weight.alias("weight"))


def _block(terms: DataFrame, block: int, floors: DataFrame | None, n_docs: int, n_terms: int) -> Block:
    rows = terms.filter(F.col("block") == block).select("query", "term", "repeats", "df", "weight").toArrow()  # about BLOCK_TERMS
    numbers: dict[bytes, int] = {}
    weights: list[int] = []
    of_query: dict[int, list[tuple[int, bytes, int, int]]] = {}
    for query, term, repeats, df, weight in zip(*(c.to_pylist() for c in rows.columns)):
        number = numbers.setdefault(term, len(numbers))
        if number == len(weights):
            weights.append(weight)
        of_query.setdefault(query, []).append((df, term, number, repeats))
    queries = [(q, np.array([t[2] for t in sorted(x)], np.int64), np.array([t[3] for t in sorted(x)], np.int64)) for q, x in sorted(of_query.items())]
    known = {} if floors is None else {r["query"]: r["floor"] for r in floors.collect()}
    return Block(numbers, np.array(weights, np.int64), queries, known, n_docs, n_terms)


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each query, best first, ties by doc_id.

    Terms are letters and digits of ASCII, A-Z lower-cased, and whatever is beyond ASCII.  With N
    documents that have a term, L terms in all, a document of n terms, tf of them the term, and df
    documents with it, w = floor(1000 * ln((2 N + 2) / (2 df + 1))), m = 75 + 25 n N div L, and the
    score is the sum over the query's terms, repeats included, of w * (10^9 tf div (1000 tf + 12 m)).

    index should be a written table: it is read once for the statistics and once or twice for
    each block of queries (about BLOCK_TERMS terms, which are broadcast).  With over 64 segments the
    square root of their number is searched first, and what the kth document reaches there is a
    floor for the others.  So candidates, k a segment at most, grow with that root, and only they move.

    Rows that repeat both id and text are one query; a query without terms, or with terms that no
    document has, finds nothing, as do null texts and an empty index; rows that repeat a doc_id are
    ranked each; null doc_ids come last among equal scores; a null item_id stays null.
    """
    rows = queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    rows = written(rows.withColumn("query", F.monotonically_increasing_id()), "search-queries")
    segments, n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).collect()[0]
    terms = written(_query_terms(rows, index, n_docs), "search-terms")
    blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    first = math.isqrt(segments) if segments > 64 else 0
    found = []
    for b in range(blocks):
        floors = None
        if first:
            block = _block(terms, b, None, n_docs, n_terms)
            some = index.filter(F.pmod(F.xxhash64("n_docs", "n_terms", "lengths"), F.lit(segments)) < first)
            floors = _ranked(_search_segments(some, block, k), k).groupBy("query").agg(F.max("rank").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k)
        found.append(written(_search_segments(index, _block(terms, b, floors, n_docs, n_terms), k), "search-found"))
    best = _ranked(functools.reduce(DataFrame.unionByName, found), k)
    return best.join(rows.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 20, item_text: str = "text", **options) -> DataFrame:
    """search_index on an index of docs that holds the queries' terms, written to the shared folder."""
    index = written(index_documents(docs, term_filter(queries, item_text)), "search-index")
    return search_index(index, queries, k, item_text=item_text, **options)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
with d as (select row_number() over () r, doc_id, {_TERMS} t from documents),
words as (select r, unnest(t) term from d),
tf as (select r, term, count(*) tf from words group by r, term),
lengths as (select r, doc_id, len(t)::bigint n from d where len(t) > 0),
total as (select count(*)::bigint nn, sum(n)::bigint ll from lengths),
weights as (select term, floor(1000 * ln((2 * max(nn) + 2)::double / (2 * count(*) + 1)))::bigint w from tf, total group by term),
items as (select row_number() over () q, item_id, text from (select distinct item_id, text from benchmark)),
asked as (select q, item_id, unnest({_TERMS}) term from items),
wanted as (select q, item_id, term, count(*) c from asked group by q, item_id, term),
scores as (
  select q, item_id, r, any_value(doc_id) doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::bigint score
  from wanted join weights using (term) join tf using (term) join lengths using (r), total group by q, item_id, r),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id) k from scores where score > 0)
select item_id, k::int rank, doc_id, score from ranked where k <= 20
"""
