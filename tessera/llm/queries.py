"""The corpus queries and their SQL; __spark_entry__.py adds them to its own."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, mixing, neighbours, ngram_join, packing, quality_classifier, quality_rules, secrets_scan, token_files, warc
from tessera.llm.common import materialize, scratch

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result written once, after which its intermediate tables are deleted. The result's own table, in the shared folder, is the caller's to delete."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark):
            return materialize(query(spark, sf_dir), query.__name__, keep=True)

    return run


@tidy
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@tidy
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@tidy
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS)


@tidy
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), BYTES)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with the digest of their whole bytes in place of the bytes."""
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


@tidy
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@tidy
def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@tidy
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.find(table(spark, sf_dir, "documents")).drop("findings", "text_hash")


@tidy
def op10_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_quality_classifier, op2_language_id, op3_ngram_jaccard_join, op4_best_fit_packing, op5_token_files, op6_warc_derivatives, op7_quality_rules, op8_learned_partitions, op9_secret_scan, op10_soft_membership_mixing, pipeline)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {}
