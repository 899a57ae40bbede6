"""The shapes that the operators take, seen in the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.columns import epoch_ms
from tessera.functions.numbering import global_sequence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without any numbering: event_id, user_id, stream_id, event_type, ts, occurred_at_ms, payload."""
    raw = table(spark, sf_dir, "events")
    return raw.select("event_id", "user_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("stream_id"), "event_type", "ts", epoch_ms("ts").alias("occurred_at_ms"), F.col("props").alias("payload"))


def versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_rows with stream_version."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return event_rows(spark, sf_dir).withColumn("stream_version", F.row_number().over(order).cast("long"))


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_rows with global_sequence and transaction_sequence (four events each)."""
    rows = global_sequence(event_rows(spark, sf_dir), "global_sequence", "ts", "event_id")
    return rows.withColumn("transaction_sequence", F.expr("(global_sequence - 1) div 4 + 1"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, current_version; a stream's versions are dense, so a count is the greatest."""
    return event_rows(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("current_version"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequenced(spark, sf_dir).groupBy("transaction_sequence").agg(F.max("occurred_at_ms").alias("committed_at_ms"), F.count("*").alias("operation_count"))


def jobs(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    """Jobs from orders. Without `ordered`, the order is known by (o_orderdate, job_id) and enqueue_sequence is left out."""
    raw = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    rows = global_sequence(raw, "enqueue_sequence", "o_orderdate", "o_orderkey") if ordered else raw
    key = F.col("o_orderkey")
    state = key % 7
    made = epoch_ms("o_orderdate")
    columns = {
        "job_id": key,
        "queue": F.col("o_orderpriority"),
        "partition_key": F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")),
        "not_before_ms": made,
        "max_attempts": F.lit(3).cast("long"),
        "effect_mode": F.expr("(o_orderkey div 7) % 2"),
        "state": state,
        "attempt": F.when(state == 0, F.lit(0).cast("long")).otherwise(key % 3 + 1),
        "worker_id": F.when(state == 1, F.concat(F.lit("w"), (key % 8).cast("string"))),
        "lease_expires_at_ms": F.when(state == 1, made + 60000 * (key % 1000)),
        "retry_after_ms": F.when(state == 2, made + 30000),
        "terminal_at_ms": F.when(state >= 4, made + 1000),
    }
    order = ["enqueue_sequence"] if ordered else ["o_orderdate"]
    return rows.select(*order, *(c.alias(n) for n, c in columns.items()))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection changes from orders; seq orders them as jobs are ordered, without a number, so that filters reach the scan."""
    raw = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    rows = raw.withColumn("seq", F.struct("o_orderdate", "o_orderkey"))
    key = F.concat(F.lit("cust:"), F.col("o_custkey").cast("string"))
    return rows.select("seq", F.col("o_orderpriority").alias("projection"), key.cast("binary").alias("key"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put").alias("op"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim receipts from line items."""
    raw = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("lease_token"))
    return raw.select(F.col("l_linenumber").cast("long").alias("transaction_id"), F.col("l_orderkey").alias("job_id"), "lease_token", (F.col("l_orderkey") % 3 + 1).alias("attempt"))
