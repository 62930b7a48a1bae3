"""The corpus pipeline: identify, deduplicate, redact, mix, tokenise. Each stage's rows are written and read again.

Null and repeated rows: a document without a letter goes in the first stage; of rows that are alike (five-word shingles,
Jaccard 0.8 or more, rows tied over others too) the second keeps one, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import language, mixing, pieces, secrets, similar
from brindle.llm.common import documents, written
from brindle.llm.queries import tokenizer


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, tokenizer("piece_bpe_32k.model")).drop("decoded")


STAGES = [("language_id", identify), ("simhash_near_dedup", near_dedup), ("secret_scans", redact), ("mixing", mix), ("sentencepiece", tokenise)]

#: PPM code lengths and lattice paths are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
