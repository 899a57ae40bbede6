"""Counts and oldest times over a store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import states as S


def counts(**tables: DataFrame) -> DataFrame:
    """name and rows of each table, one aggregation each."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in tables.items()))


def jobs_by_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("jobs")).select(S.state_name("state").alias("state"), "jobs")


def oldest_active_lease(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("state") == S.LEASED).agg(F.min("lease_expires_at_ms").alias("oldest_active_lease_ms"))


def oldest_uncertain_job(jobs: DataFrame, transactions: DataFrame, on: str) -> DataFrame:
    """The earliest commit that made a job uncertain which still is."""
    return jobs.where(F.col("state") == S.UNCERTAIN).join(transactions, on).agg(F.min("committed_at_ms").alias("oldest_uncertain_job_ms"))
