"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, languages, licenses, mixing, periodic_runs, pii, quality, repeats, search, token_counts, token_ids, toxicity
from .common import documents


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item that a document holds, over all documents."""
    return decontamination.leak_rows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by its mixture."""
    return languages.predicted_languages(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that give it away."""
    return pii.private_digests(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component and links of every document, at 90 % of three-word shingles."""
    return jaccard_join.join_documents(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the file of token ids."""
    return token_ids.token_id_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that came earlier."""
    return repeats.repeat_digests(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality.quality(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    return mixing.mix_plan(documents(spark, sf_dir))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names or quotes."""
    return licenses.license_rows(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, with the planted repeats."""
    return periodic_runs.run_digests(documents(spark, sf_dir))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item, over all documents."""
    return search.search_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_language_id, op3_pii, op4_jaccard_join, op5_token_counts, op6_token_ids, op7_repeated_text, op8_quality_rules, op9_toxicity, op10_source_mix,
        op11_licenses, op12_periodic_runs, op13_search,
    )
}

ORACLES: dict[str, str] = {"op8_quality_rules": quality.SQL, "op10_source_mix": mixing.SQL, "op13_search": search.SQL}
