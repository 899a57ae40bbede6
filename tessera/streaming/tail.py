"""Following an event table as a stream: each micro-batch becomes commits of a store, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def tail(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New rows of a folder of Parquet files, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def follow(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls handle(batch, batch_id) for all rows that are there. A batch that is run again has the same id, so a
    handler that derives its transaction ids from it commits each batch once."""
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transaction_id(query: str, batch_id: int) -> bytes:
    """The same 16 bytes for the same batch of a query."""
    import hashlib

    return hashlib.sha256(f"{query}/{batch_id}".encode()).digest()[:16]
