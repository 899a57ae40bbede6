"""Integrity checks: each gives (check, detail) rows; a sound store gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import states as S


def finding(rows: DataFrame, check: str, *parts) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)).alias("detail"))


def text(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def stream_versions(streams: DataFrame, events: DataFrame) -> DataFrame:
    """Streams whose version is not that of their last event (0 without any)."""
    last = events.groupBy("stream_id").agg(F.max("stream_version").alias("last"))
    wrong = streams.join(last, "stream_id", "left").withColumn("last", F.coalesce("last", F.lit(0).cast("long"))).where("current_version <> last")
    return finding(wrong, "stream_versions", text("stream_id"), " is at ", text("current_version"), ", its events at ", text("last"))


def orphan_streams(streams: DataFrame, events: DataFrame) -> DataFrame:
    """Streams of events that the table of streams does not know."""
    return finding(events.select("stream_id").distinct().join(streams, "stream_id", "left_anti"), "stream_versions", "no stream ", text("stream_id"))


def terminal_jobs(jobs: DataFrame) -> DataFrame:
    """Ended jobs that still have part of a lease."""
    held = F.col("worker_id").isNotNull() | F.col("lease_expires_at_ms").isNotNull() | F.col("lease_token").isNotNull()
    return finding(jobs.where(F.col("state").isin(*S.TERMINAL) & held), "terminal_jobs", "job ", text("job_id"), " has ended with a lease")


def leased_jobs(jobs: DataFrame) -> DataFrame:
    """Leased jobs that lack part of their lease."""
    lacking = F.col("worker_id").isNull() | F.col("lease_expires_at_ms").isNull() | F.col("lease_token").isNull()
    return finding(jobs.where((F.col("state") == S.LEASED) & lacking), "leased_jobs", "job ", text("job_id"), " lacks part of its lease")


def active_partitions(partitions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active partitions without an active job."""
    active = jobs.where(F.col("state").isin(*S.ACTIVE)).select("queue", "partition_key")
    return finding(partitions.join(active, ["queue", "partition_key"], "left_anti"), "active_partitions", text("queue"), "/", text("partition_key"), " has no active job")


def receipt_jobs(receipts: DataFrame, jobs: DataFrame) -> DataFrame:
    return finding(receipts.join(jobs.select("job_id"), "job_id", "left_anti"), "claim_receipts", "receipt of transaction ", text("transaction_id"), ": missing job ", text("job_id"))


def receipt_transactions(receipts: DataFrame, transactions: DataFrame) -> DataFrame:
    return finding(receipts.join(transactions.select("transaction_id"), "transaction_id", "left_anti"), "claim_receipts", "receipt of job ", text("job_id"), ": missing transaction ", text("transaction_id"))


def foreign_key(child: DataFrame, column: str, parent: DataFrame, name: str) -> DataFrame:
    """Values of a child's column that its parent does not have, each once."""
    keys = child.select(F.col(column).alias("value")).where("value is not null").distinct()
    return finding(keys.join(parent.select(F.col(column).alias("value")), "value", "left_anti"), "foreign_key_check", name, ".", column, " ", text("value"))


def report(*findings: DataFrame) -> DataFrame:
    """All findings as one table."""
    return reduce(DataFrame.unionByName, findings)
