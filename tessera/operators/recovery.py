"""What became of transactions and claims whose outcome is unknown to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import states as S


def recover_claim(receipts: DataFrame, jobs: DataFrame, now_ms: int, transaction_id=None) -> DataFrame:
    """job_id and executable for the receipts of a claim (of all claims without one): still leased by the same token, and not expired."""
    if transaction_id is not None:
        receipts = receipts.where(F.col("transaction_id") == transaction_id)
    now = jobs.select("job_id", "state", F.col("lease_token").alias("held_token"), F.col("lease_expires_at_ms").alias("held_until"))
    good = (F.col("state") == S.LEASED) & (F.col("held_token") == F.col("lease_token")) & (F.col("held_until") >= now_ms)
    return receipts.join(now, "job_id").select("transaction_id", "job_id", F.coalesce(good, F.lit(False)).alias("executable"))


def recover_transactions(asked: DataFrame, transactions: DataFrame) -> DataFrame:
    """The receipt of each asked transaction_sequence, or absent."""
    return asked.join(transactions, "transaction_sequence", "left").select("transaction_sequence", F.when(F.col("operation_count").isNull(), "absent").otherwise("committed").alias("outcome"), "committed_at_ms", "operation_count")
