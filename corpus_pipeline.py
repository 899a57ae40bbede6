"""A corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing and packing, each over all that the one before kept.

Defined cases: null and empty texts fail the quality rules; very long texts go through whole; rows without doc_id
are kept by the join; of rows that share a doc_id the join keeps one; an empty table gives no rows; columns of
documents, whatever their names, reach the packing, which reads doc_id and text. Each stage's table is deleted once
the next one is written; the last one's is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, ngram_join, packing, quality_rules, secrets_scan
from tessera.llm.common import delete, materialize, scratch
from tessera.llm.queries import WORDS, table

#: SQL cannot express the join, the classifier or the packing.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets replaced by their kind."""
    return secrets_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target weights of their domains ask."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, WORDS)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a Parquet table that the next one reads."""
    docs, old = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", keep=True)
        for path in old:
            delete(spark, path)
        old = list({f.rsplit("/", 1)[0] for f in docs.inputFiles()})
    return docs
