"""Toxicity by a factorization machine over hashed terms: weights of terms plus learned pairwise interactions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, fold, hash_share

BITS = 20
#: Bytes of text that a worker holds as terms at a time.
SLICE = 4 << 20
TERM = re.compile(r"[^\W_]+")


def buckets(text: str | None) -> np.ndarray:
    """Sorted distinct hash buckets of the terms of a text."""
    terms = set(TERM.findall((text or "").lower()))
    return np.unique(np.array([zlib.crc32(t.encode()) for t in terms], np.uint32) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Machine:
    bias: float
    #: Place of a bucket in weights and factors; the last is all 0, for buckets that weren't learned.
    place: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        at = self.place[np.concatenate([*rows, np.zeros(0, np.int64)])]
        of = np.repeat(np.arange(len(rows)), sizes)
        linear = np.bincount(of, self.weights[at], len(rows))
        v = self.factors[at]
        sums = np.stack([np.bincount(of, v[:, k], len(rows)) for k in range(v.shape[1])], 1)
        squares = np.bincount(of, (v * v).sum(1), len(rows))
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares)


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, min_docs: int = 5, epochs: int = 10, rate: float = 0.2, l1: float = 1e-3, l2: float = 1e-4, seed: int = 7) -> Machine:
    """By proximal AdaGrad on the logistic loss, on terms that min_docs rows or more hold."""
    seen = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=1 << BITS)
    learned = np.flatnonzero(seen >= min_docs)
    place = np.full(1 << BITS, len(learned), np.int32)
    place[learned] = np.arange(len(learned))
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(learned) + 1), random.normal(0, 0.01, (len(learned) + 1, factors))
    v[-1] = 0
    share = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    own = [p[p < len(learned)] for p in (place[r] for r in rows)]
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for b in range(0, len(rows), 32):
            batch = order[b : b + 32]
            at = np.concatenate([own[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(own[i]) for i in batch])
            va = v[at]
            sums = np.stack([np.bincount(of, va[:, k], len(batch)) for k in range(factors)], 1)
            squares = np.bincount(of, (va * va).sum(1), len(batch))
            score = bias + np.bincount(of, w[at], len(batch)) + 0.5 * ((sums * sums).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[batch]) / len(batch)
            used, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, g[of], len(used)) + l2 * w[used]
            each = g[of][:, None] * (sums[of] - va)
            dv = np.stack([np.bincount(inverse, each[:, k], len(used)) for k in range(factors)], 1) + l2 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            step = rate / np.sqrt(gw[used])
            moved = w[used] - step * dw
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            v[used] -= 0.2 * rate / np.sqrt(gv[used]) * dv
            bias -= rate / np.sqrt(gb) * g.sum()
    return Machine(bias, place, w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """From a hashed sample of about `sample` labelled rows, whole texts.

    The sample's ids are broadcast and its terms, hashed, come to the driver: both within the
    sample's bound.  Null labels and ids aren't learned from; without labels every score is about 0.1 %.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
    rate = min(1.0, sample / max(1, usable.count()))
    some = usable.filter(hash_share("_id", "toxic:") < rate)
    joined = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2, SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([buckets(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["id", "label", "terms"])

    table = joined.select("_id", "_label", "_text").mapInArrow(hashed, "id long, label int, terms binary").toArrow()
    rows = sorted(zip(table.column("id").to_pylist(), table.column("label").to_pylist(), table.column("terms").to_pylist()))
    return fit([np.frombuffer(t, "<i4").astype(np.int64) for _, _, t in rows], np.array([label for _, label, _ in rows], float))


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on) in place of text_col.

    Null and empty texts get the score of no terms; rows are judged alone, whole; columns of those
    two names are replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2 ** BITS places and the sample's terms
    rows = docs.drop("score", "predicted")
    kept = [c for c in rows.columns if c != text_col]

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, text_col, SLICE, 500):
            p = 1 / (1 + np.exp(-np.clip(shared.value.logits([buckets(t) for t in part.column(text_col).to_pylist()]), -500, 500)))
            columns = [*(part.column(c) for c in kept), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted"])

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return rows.mapInArrow(predict, T.StructType([*rows.select(*kept).schema.fields, *fields]))


def held_out(id_col: str = "doc_id"):
    return fold(id_col, 5) == 0


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs, learned from the labelled rows that aren't held out.

    A null doc_id counts as the empty text in the split; texts without terms get the score of the
    bias; repeated rows have equal scores; labels of documents that docs lacks are left out.
    """
    machine = train(docs, labels.filter(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), machine)
