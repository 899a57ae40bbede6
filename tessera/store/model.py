"""Commands, limits and ids."""

from __future__ import annotations

import hashlib
import secrets
from dataclasses import dataclass, field, fields

from tessera.functions import states as S
from tessera.store.errors import Invalid

ZERO = bytes(16)
MOST_MS = (1 << 63) - 1


def new_id() -> bytes:
    """16 random bytes, never all zero."""
    while (made := secrets.token_bytes(16)) == ZERO:
        pass
    return made


def parse_id(text: str) -> bytes:
    """An id from 32 hex digits of either case."""
    try:
        made = bytes.fromhex(text)
    except ValueError:
        made = b""
    if len(made) != 16 or len(text) != 32:
        raise Invalid(f"no id: {text!r}")
    return made


@dataclass(frozen=True)
class Limits:
    """Most bytes of each kind of value, and most operations and replaced entries of a commit."""

    event_payload: int = 1 << 20
    metadata: int = 64 << 10
    projection_key: int = 1 << 20
    projection_value: int = 4 << 20
    job_payload: int = 1 << 20
    operations: int = 1024
    string: int = 4096
    summary: int = 4096
    replace_entries: int = 10_000

    def __post_init__(self):
        if self.operations <= 0 or self.replace_entries <= 0:
            raise Invalid("operations and replace_entries must be above 0")

    def check(self, kind: str, value: bytes | str, what: str) -> None:
        size = len(value.encode() if isinstance(value, str) else value)
        if size > getattr(self, kind):
            raise Invalid(f"{what} exceeds limit: {size} > {getattr(self, kind)}")


@dataclass(frozen=True)
class Event:
    event_id: bytes
    stream_id: str
    event_type: str
    occurred_at_ms: int
    payload: bytes = b""
    metadata: bytes = b""
    schema_version: int = 1
    causation_id: bytes | None = None
    correlation_id: bytes | None = None


@dataclass
class ProjectionPatch:
    """Ordered mutations of a projection that is at expected_version; it is at the next one afterwards."""

    projection: str
    expected_version: int
    mutations: list[tuple] = field(default_factory=list)

    def put(self, key: bytes, value: bytes) -> ProjectionPatch:
        self.mutations.append(("put", key, value))
        return self

    def delete(self, key: bytes) -> ProjectionPatch:
        self.mutations.append(("delete", key))
        return self

    def clear(self) -> ProjectionPatch:
        self.mutations.append(("clear",))
        return self

    def replace(self, entries: list[tuple[bytes, bytes]]) -> ProjectionPatch:
        self.mutations.append(("replace", list(entries)))
        return self

    def check(self, limits: Limits) -> None:
        """No key twice since the last clear or replace, and sizes."""
        seen: set[bytes] = set()
        for kind, *rest in self.mutations:
            if kind in ("clear", "replace"):
                seen = set()
            touched = {"put": rest[:1], "delete": rest[:1], "clear": [], "replace": [k for k, _ in rest[0]] if kind == "replace" else []}[kind]
            if kind == "replace" and len(touched) > limits.replace_entries:
                raise Invalid(f"replace entry count {len(touched)} exceeds limit {limits.replace_entries}")
            for key in touched:
                if key in seen:
                    raise Invalid("a key is touched twice in a patch")
                seen.add(key)
                limits.check("projection_key", key, "projection key")
            for value in [rest[1]] if kind == "put" else [v for _, v in rest[0]] if kind == "replace" else []:
                limits.check("projection_value", value, "projection value")


@dataclass(frozen=True)
class JobSpec:
    job_id: bytes
    queue: str
    partition_key: str
    payload: bytes = b""
    not_before_ms: int = 0
    max_attempts: int = 3
    effect_mode: int = S.RECONCILABLE
    idempotency_key: str | None = None

    @classmethod
    def reconcilable(cls, job_id, queue, partition_key, payload=b"", **more):
        return cls(job_id, queue, partition_key, payload, effect_mode=S.RECONCILABLE, **more)

    @classmethod
    def idempotent(cls, job_id, queue, partition_key, payload=b"", key: str | None = None, **more):
        """An effect that is safe to repeat, by its nature or by a key that the worker passes on."""
        return cls(job_id, queue, partition_key, payload, effect_mode=S.IDEMPOTENT, idempotency_key=key, **more)


@dataclass
class CommitBatch:
    """Expectations and operations, in order, of one transaction."""

    transaction_id: bytes
    committed_at_ms: int
    correlation_id: bytes | None = None
    metadata: bytes = b""
    expected: list[tuple[str, int]] = field(default_factory=list)
    operations: list[tuple] = field(default_factory=list)

    def _add(self, *operation) -> CommitBatch:
        self.operations.append(operation)
        return self

    def expect_stream_version(self, stream: str, version: int) -> CommitBatch:
        self.expected.append((stream, version))
        return self

    def append_event(self, event: Event) -> CommitBatch:
        return self._add("event", event)

    def apply_projection_patch(self, patch: ProjectionPatch) -> CommitBatch:
        return self._add("patch", patch)

    def enqueue_job(self, spec: JobSpec) -> CommitBatch:
        return self._add("enqueue", spec)

    def acknowledge_job(self, job_id: bytes, token: bytes, result_digest: bytes | None = None) -> CommitBatch:
        return self._add("ack", job_id, token, result_digest)

    def fail_job(self, job_id: bytes, token: bytes, summary: str, retry_after_ms: int | None = None) -> CommitBatch:
        return self._add("fail", job_id, token, summary, retry_after_ms)

    def cancel_job(self, job_id: bytes, token: bytes | None = None) -> CommitBatch:
        return self._add("cancel", job_id, token)

    def resolve_uncertain_job(self, job_id: bytes, resolution: str) -> CommitBatch:
        return self._add("resolve", job_id, resolution)

    def extend_lease(self, job_id: bytes, token: bytes, new_expiry_ms: int) -> CommitBatch:
        return self._add("extend", job_id, token, new_expiry_ms)

    def check(self, limits: Limits) -> None:
        """The rules that hold whatever the store holds."""
        if self.transaction_id == ZERO:
            raise Invalid("transaction id cannot be zero")
        if len(self.operations) > limits.operations:
            raise Invalid(f"operation count {len(self.operations)} exceeds limit {limits.operations}")
        limits.check("metadata", self.metadata, "metadata")
        for stream, _ in self.expected:
            limits.check("string", stream, "stream id")
        for kind, first, *rest in self.operations:
            if kind == "event":
                if first.event_id == ZERO:
                    raise Invalid("event id cannot be zero")
                for name, what in (("stream_id", "stream id"), ("event_type", "event type")):
                    limits.check("string", getattr(first, name), what)
                limits.check("event_payload", first.payload, "event payload")
                limits.check("metadata", first.metadata, "metadata")
            elif kind == "patch":
                limits.check("string", first.projection, "projection")
                first.check(limits)
            elif kind == "enqueue":
                if first.job_id == ZERO:
                    raise Invalid("job id cannot be zero")
                if first.max_attempts < 1:
                    raise Invalid("job max_attempts must be at least 1")
                for name, what in (("queue", "queue"), ("partition_key", "partition key"), ("idempotency_key", "idempotency key")):
                    limits.check("string", getattr(first, name) or "", what)
                limits.check("job_payload", first.payload, "job payload")
            elif kind != "resolve":
                if rest[0] == ZERO:
                    raise Invalid("lease token cannot be zero")
                if kind == "fail":
                    limits.check("summary", rest[1], "error summary")

    def digest(self) -> bytes:
        """SHA-256 of all content but the transaction id: each value with its length, each choice with a tag."""
        out = hashlib.sha256()
        number = lambda n: out.update((n % (1 << 64)).to_bytes(8, "big"))

        def put(layout: str, *values) -> None:
            """A value by each letter: t a tag, n a number, b bytes or text with their length, i an id; capitals may be None."""
            for letter, value in zip(layout, values, strict=True):
                if letter.isupper():
                    out.update(b"\0" if value is None else b"\1")
                if letter.lower() == "n" and value is not None:
                    number(value)
                elif letter == "t":
                    out.update(bytes([value]))
                elif value is not None:
                    data = value.encode() if isinstance(value, str) else value
                    if letter.lower() == "b":
                        number(len(data))
                    out.update(data)

        put("nIb", self.committed_at_ms, self.correlation_id, self.metadata)
        number(len(self.expected))
        for stream, version in self.expected:
            put("bn", stream, version)
        number(len(self.operations))
        for kind, x, *rest in self.operations:
            if kind == "event":
                put("tibbnnIIbb", 1, x.event_id, x.stream_id, x.event_type, x.schema_version, x.occurred_at_ms, x.causation_id, x.correlation_id, x.payload, x.metadata)
            elif kind == "patch":
                put("tbnnn", 2, x.projection, x.expected_version, x.expected_version + 1, len(x.mutations))
                for what, *args in x.mutations:
                    if what == "replace":
                        put("tn", 4, len(args[0]))
                        for pair in args[0]:
                            put("bb", *pair)
                    else:
                        put("t" + "b" * len(args), {"put": 1, "delete": 2, "clear": 3}[what], *args)
            elif kind == "enqueue":
                put("tibbbnntB", 3, x.job_id, x.queue, x.partition_key, x.payload, x.not_before_ms, x.max_attempts, x.effect_mode, x.idempotency_key)
            elif kind == "ack":
                put("tiiB", 4, x, *rest)
            elif kind == "fail":
                put("tiibN", 5, x, *rest)
            elif kind == "cancel":
                put("tiI", 6, x, *rest)
            elif kind == "resolve":
                put("tit", 7, x, ("retry", "succeeded", "dead").index(rest[0]) + 1)
            else:
                put("tiin", 8, x, *rest)
        return out.digest()


def as_row(value) -> dict:
    return {f.name: getattr(value, f.name) for f in fields(value)}
