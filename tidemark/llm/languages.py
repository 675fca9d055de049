"""Language mixtures of documents.

Each language has likelihoods of hashed byte trigrams.  Expectation-maximisation estimates in which
proportions the languages make up a document; of the sets of its likeliest languages the one with
the best penalised likelihood is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, fold, hash_share, released

BUCKETS = 1 << 15
#: Bytes of text whose trigrams a worker holds at a time, but for a longer text.
SLICE = 1 << 18
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: What identify adds.
RESULTS = ("lang_pred", "score", "languages", "gain")

# Letters a to z, bytes of other letters, and all else as a gap.
CODES = np.zeros(256, np.uint32)
CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
CODES[128:] = np.arange(27, 27 + 128)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, bucket) of each trigram that isn't all gap; none crosses texts."""
    raw = [t.lower().encode() for t in texts]
    codes = CODES[np.frombuffer(b"\n\n".join(raw) + b"\n\n", np.uint8)]
    sizes = np.array([len(r) + 2 for r in raw])
    of = np.repeat(np.arange(len(raw)), sizes)
    start = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    start[ends - 1] = start[ends - 2] = False
    tri = codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]
    keep = start[:-2] & (tri > 0)
    return of[:-2][keep], (tri[keep] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Likelihood of each bucket in each language: (BUCKETS, languages).
    likelihood: np.ndarray


def train(docs: DataFrame, per_language: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From a hashed sample of about per_language documents of each language, whole texts.

    What comes to the driver is a count of rows per language and of trigrams per language and
    bucket, whatever the size of docs.
    """
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    rates = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    sample = rows.filter(hash_share("doc_id", "lang:") < F.element_at(rates, F.col("lang")))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in byte_slices(batches, 0, SLICE, 200):
            langs = np.array(part.column(1).to_pylist(), object)
            of, buckets = trigrams([t or "" for t in part.column(0).to_pylist()])
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + np.bincount(buckets[(langs == lang)[of]], minlength=BUCKETS)
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], names=["lang", "bucket", "n"])

    counts = sample.select("text", "lang").mapInArrow(released(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {lang: k for k, lang in enumerate(languages)}
    n = np.zeros((BUCKETS, len(languages)))
    n[counts.column("bucket").to_numpy(), [place[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    return Model(languages, ((n + 0.1) / (n + 0.1).sum(0)).astype(np.float32))


def proportions(of: np.ndarray, likelihood: np.ndarray, weight: np.ndarray, n_docs: int, rounds: int) -> np.ndarray:
    """(documents, languages): maximum-likelihood proportions.  of is sorted; every document has a row."""
    starts = np.searchsorted(of, np.arange(n_docs))
    total = np.add.reduceat(weight, starts)
    share = np.full((n_docs, likelihood.shape[1]), 1 / likelihood.shape[1], np.float32)
    for _ in range(rounds):
        joint = likelihood * share[of]
        joint *= (weight / joint.sum(1))[:, None]
        share = np.add.reduceat(joint, starts) / total[:, None]
    return share


def log_likelihood(of: np.ndarray, likelihood: np.ndarray, weight: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weight * np.log((likelihood * share[of]).sum(1) + 1e-30), np.searchsorted(of, np.arange(len(share))))


def infer(texts: list[str], model: Model, rounds: int = 10, penalty: float = 1.0) -> np.ndarray:
    """The proportions of fitted."""
    return fitted(texts, model, rounds, penalty)[0]


def fitted(texts: list[str], model: Model, rounds: int = 10, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages): proportions over the chosen set of languages; and each text's gain; all 0 where a text has no letter.

    Sets are the first k languages by their proportion among all; each language costs
    penalty / 2 * log(trigrams).  The gain is the penalised log-likelihood of the set over that of
    no language, in which all buckets are equally likely, a trigram.
    """
    result, gain = np.zeros((len(texts), len(model.languages)), np.float32), np.zeros(len(texts))
    real = [i for i, t in enumerate(texts) if LETTER.search(t)]
    if not real or not model.languages:
        return result, gain
    of, buckets = trigrams([texts[i] for i in real])
    pairs, weight = np.unique(of * np.int64(BUCKETS) + buckets, return_counts=True)
    of, likelihood, weight = pairs // BUCKETS, model.likelihood[pairs % BUCKETS], weight.astype(np.float32)
    n = len(real)
    share = proportions(of, likelihood, weight, n, rounds)
    total = np.add.reduceat(weight, np.searchsorted(of, np.arange(n)))
    cost = penalty / 2 * np.log(total)
    order = np.argsort(-share, axis=1, kind="stable")
    chosen = np.zeros_like(share)
    np.put_along_axis(chosen, order[:, :1], 1, 1)
    best = log_likelihood(of, likelihood, weight, chosen)
    bound = log_likelihood(of, likelihood, weight, share)  # no set is likelier
    for k in range(2, share.shape[1] + 1):
        open_docs = np.flatnonzero(bound - (k - 1) * cost > best)
        if not len(open_docs):
            break
        mine = np.isin(of, open_docs)
        sub_of = np.searchsorted(open_docs, of[mine])
        member = np.zeros((len(open_docs), share.shape[1]), np.float32)
        np.put_along_axis(member, order[open_docs, :k], 1, 1)
        sub_likelihood = likelihood[mine] * member[sub_of]
        sub_share = proportions(sub_of, sub_likelihood + 1e-30, weight[mine], len(open_docs), rounds)
        value = log_likelihood(sub_of, sub_likelihood, weight[mine], sub_share) - (k - 1) * cost[open_docs]
        better = value > best[open_docs]
        chosen[open_docs[better]], best[open_docs[better]] = sub_share[better] * member[better], value[better]
    result[real], gain[real] = chosen, best / total + np.log(BUCKETS)
    return result, gain


def identify(docs: DataFrame, model: Model, min_share: float = 0.0, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (the language of the largest share, UNKNOWN if none), score (that share), languages (the chosen set) and gain.

    A gain below 0 says that no set of languages explains the text better than none does (fitted).
    Null texts and texts without a letter are UNKNOWN with score and gain 0; those whose largest
    share is below min_share are UNKNOWN with score 0; of equal shares the first language in
    code-point order counts.  Rows are judged alone, whole, whatever their ids; columns of those four
    names (RESULTS) are replaced; an empty table gives no rows, and an empty model UNKNOWN only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages
    kept = docs.drop(*RESULTS)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("gain", T.DoubleType())])

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in byte_slices(batches, text_col, SLICE, 250):
            shares, gain = fitted([t or "" for t in part.column(text_col).to_pylist()], model)
            top = shares.argmax(1) if model.languages else np.zeros(len(shares), int)
            score = shares.max(1, initial=0.0).astype(np.float64)
            named = (score > 0) & (score >= min_share)
            langs = [model.languages[k] if ok else UNKNOWN for k, ok in zip(top, named)]
            sets = [[model.languages[k] for k in np.flatnonzero(s > 0)] for s in shares]
            columns = [*part.columns, pa.array(langs, pa.string()), pa.array(np.where(named, np.minimum(score, 1.0), 0.0)), pa.array(sets, pa.list_(pa.string())), pa.array(gain, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *RESULTS])

    return kept.mapInArrow(released(predict), schema)


def held_out(id_col: str = "doc_id"):
    return fold(id_col, 4) == 2


def predicted_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, gain), a row for each row of docs, learned from the rows that aren't held out.

    A null doc_id counts as the empty text in the split; rows without a lang teach nothing; the
    other cases are identify's.
    """
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
