"""Tables of a store, their keys, and the record of schema versions."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

# Fixed shapes: table, columns, key.
TABLES = {
    "transactions": ("transaction_id binary, transaction_sequence long, committed_at_ms long, correlation_id binary, metadata binary, request_digest binary, operation_count long", ("transaction_id",)),
    "events": ("global_sequence long, event_id binary, transaction_id binary, stream_id string, stream_version long, event_type string, schema_version int, occurred_at_ms long, causation_id binary, correlation_id binary, payload binary, metadata binary", ("event_id",)),
    "streams": ("stream_id string, current_version long", ("stream_id",)),
    "projection_meta": ("projection string, version long", ("projection",)),
    "projection_entries": ("projection string, key binary, value binary", ("projection", "key")),
    "jobs": (
        "job_id binary, enqueue_sequence long, enqueue_transaction_id binary, queue string, partition_key string, payload binary, not_before_ms long, max_attempts int, effect_mode int, idempotency_key string, state int, attempt int, "
        "lease_token binary, worker_id string, lease_expires_at_ms long, retry_after_ms long, terminal_at_ms long, result_digest binary, error_summary string, updated_transaction_id binary",
        ("job_id",),
    ),
    "queue_cursors": ("queue string, last_partition_key string", ("queue",)),
    "claim_receipts": ("transaction_id binary, job_id binary, lease_token binary, attempt int, worker_id string, lease_expires_at_ms long", ("transaction_id", "job_id")),
}
VERSION = 1
KINDS = {"binary": BinaryType, "int": IntegerType, "long": LongType, "string": StringType}


def schema(name: str):
    return StructType([StructField(c, KINDS[kind]()) for c, kind in (part.split() for part in TABLES[name][0].split(", "))])


def columns(name: str) -> list[str]:
    return [f.name for f in schema(name)]


def fnv1a_128(data: bytes) -> bytes:
    """FNV-1a of 128 bits, big-endian."""
    value = 0x6C62272E07BB014262B821756295C58D
    for byte in data:
        value = (value ^ byte) * 0x0000000001000000000000000000013B & (1 << 128) - 1
    return value.to_bytes(16, "big")


def checksum() -> str:
    """Of the tables as they are."""
    return fnv1a_128(repr(sorted(TABLES.items())).encode()).hex()
