"""Reads and bulk checks of event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.columns import limited


def events_after(events: DataFrame, after: int, limit: int | None) -> DataFrame:
    """The first events above a global sequence."""
    return limited(events.where(F.col("global_sequence") > after).orderBy("global_sequence"), limit)


def stream_events(events: DataFrame, stream: str, first: int, limit: int | None) -> DataFrame:
    """A stream's events from a version on, that one included."""
    return limited(events.where((F.col("stream_id") == stream) & (F.col("stream_version") >= first)).orderBy("stream_version"), limit)


def last_events(events: DataFrame, n: int | None) -> DataFrame:
    """The newest n events, oldest first."""
    return limited(events.orderBy(F.desc("global_sequence")), n).orderBy("global_sequence")


def get_event(events: DataFrame, event_id) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


def stream_version(streams: DataFrame, stream: str) -> DataFrame:
    """One row: the stream's version, 0 if there is no such stream."""
    return streams.where(F.col("stream_id") == stream).agg(F.coalesce(F.max("current_version"), F.lit(0).cast("long")).alias("current_version"))


def assign_versions(batch: DataFrame, streams: DataFrame, order: list[str]) -> DataFrame:
    """stream_version of new events: their place within the stream above what the stream has."""
    place = F.row_number().over(W.partitionBy("stream_id").orderBy(*order)).cast("long")
    return batch.join(streams, "stream_id", "left").withColumn("stream_version", F.coalesce("current_version", F.lit(0)) + place).drop("current_version")


def upsert_streams(streams: DataFrame, written: DataFrame) -> DataFrame:
    """Streams after a batch (stream_id, current_version of each that it wrote or expected, at 0 too): the greatest version of each."""
    return streams.unionByName(written).groupBy("stream_id").agg(F.max("current_version").alias("current_version"))


def big_endian(number: str | Column) -> Column:
    """A number as 8 bytes."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def expectation_digest(batches: DataFrame) -> DataFrame:
    """request_digest of batches without operations (transaction_id, committed_at_ms, metadata, stream_id, expected), over the same bytes as CommitBatch.digest()."""
    sized = lambda c: F.concat(big_endian(F.octet_length(c).cast("long")), F.col(c).cast("binary"))
    none, one, zero = F.lit(b"\0"), big_endian(F.lit(1).cast("long")), big_endian(F.lit(0).cast("long"))
    data = F.concat(big_endian("committed_at_ms"), none, sized("metadata"), one, sized("stream_id"), big_endian("expected"), zero)
    return batches.select("transaction_id", F.sha2(data, 256).alias("request_digest"))


def expected_version_conflicts(expected: DataFrame, streams: DataFrame) -> DataFrame:
    """Expectations (stream_id, expected) that the durable version does not meet."""
    found = expected.join(streams, "stream_id", "left").select("stream_id", "expected", F.coalesce("current_version", F.lit(0).cast("long")).alias("actual"))
    return found.where(F.col("expected") != F.col("actual"))


def duplicate_event_ids(batch: DataFrame, events: DataFrame) -> DataFrame:
    """Ids that would be there more than once after the batch; each such id fails the whole batch."""
    return batch.select("event_id").unionByName(events.select("event_id")).groupBy("event_id").agg(F.count("*").alias("copies")).where("copies > 1")


def resubmission_outcome(batches: DataFrame, committed: DataFrame) -> DataFrame:
    """new, same or different for each (transaction_id, digest) against what is committed."""
    known = committed.select("transaction_id", F.col("digest").alias("known"))
    outcome = F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("digest"), "same").otherwise("different")
    return batches.join(known, "transaction_id", "left").select("transaction_id", outcome.alias("outcome"))
