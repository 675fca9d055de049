"""A corpus pipeline of five stages: each works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, languages, mixing, token_ids
from tidemark.llm.common import documents, marked, written

#: Words whose ids a worker of the last stage remembers: fewer than that operator's own, as the worker holds what earlier stages left.
KNOWN_WORDS = 200_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def kept_rows(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], results: tuple[str, ...], condition: Column) -> DataFrame:
    """The rows of docs whose results meet the condition; docs may have own columns of those names, which come out as they were."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in results}
    found = operator(docs.withColumnsRenamed(aside)).filter(condition)
    return found.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a mixture of languages that can be told, learned from those with a lang.

    A text without a letter goes, null and empty ones too, and one that no set of the learned
    languages explains better than none does (a gain of 0 or less, see languages.fitted): noise,
    or a language or script that wasn't learned.  Each row is judged alone, null ids and repeated
    rows as well; an empty table, or one without a lang, keeps none.
    """
    model = languages.train(docs)
    return kept_rows(docs, lambda d: languages.identify(d, model), languages.RESULTS, (F.col("lang_pred") != languages.UNKNOWN) & (F.col("gain") > 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, exact: bool | None = None) -> DataFrame:
    """One document of each group that the join links, the one with the smallest doc_id, null last.

    Groups are of five-word shingles and a similarity of 0.8 or more.  Each row is judged by its
    own text, so a row that is linked with nothing stays, whatever other rows of its doc_id, null
    too, are linked with; rows that repeat both doc_id and text are one, without words as well.  exact
    finds the groups without minhashes, which lose a pair at the threshold with a chance of 1e-10.
    """
    verdicts = written(jaccard_join.verdicts(docs, n=5, percent=80, exact=exact).withColumn("_row", F.xxhash64("doc_id", "text_key")).select("_row", F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.col("stays").alias("_stays")), "verdicts")
    doc_id, text_key = jaccard_join.row_key()
    rows = docs.withColumns({"_id": doc_id, "_text": text_key, "_row": F.xxhash64(doc_id, text_key)})
    # most rows have no verdict, and don't move; of those that do, copies of a row combine before they move
    judged = marked(rows, verdicts, "_row").dropDuplicates(["_id", "_text"]).join(verdicts.drop("_row"), ["_id", "_text"], "left").filter(F.coalesce("_stays", F.lit(True)))
    return judged.select(*docs.columns).unionByName(marked(rows, verdicts, "_row", yes=False).select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as all rows do if the benchmark is empty; each row is
    judged alone, repeated rows as well.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return kept_rows(docs, lambda d: decontamination.find_leaks(d, benchmark), ("leaks",), F.size("leaks") == 0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it.

    Null and empty texts are taken no times; rows without a source are a source of their own; rows
    that repeat a doc_id, or have none, are mixed alike.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each copy, from the token file as read back.

    Null and empty texts are the end id alone; a null doc_id comes first; an empty table has no rows.
    """
    return token_ids.token_id_digests(docs, public_tokenizers.path("word_bpe_49k.json"), KNOWN_WORDS)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: Language models, alignments and tokenizers aren't for SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
