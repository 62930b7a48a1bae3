"""Queries of the corpus operators with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language, media, mixing, oracles, pieces, secrets, simhash, sketch, substring, suffix_dedup, token_counts
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model")).drop("ids", "decoded")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.document_fingerprints(documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(documents(spark, sf_dir)).drop("kept")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(documents(spark, sf_dir)).drop("kept", "n_factors")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.learn(docs))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_suffix_array_dedup,
        op3_sentencepiece,
        op4_secret_scans,
        op5_substring_dedup,
        op6_token_counts,
        op7_language_id,
        op8_media_columns,
        op9_simhash_near_dedup,
        op10_document_fingerprints,
    )
}
#: The others have no SQL: fits, models, libraries' ids and hashes that SQL lacks; tests compare them with plain versions.
ORACLES: dict[str, str] = {"op2_suffix_array_dedup": oracles.BYTES, "op5_substring_dedup": oracles.SUBSTRING}
