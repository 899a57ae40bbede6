"""What can go wrong; every error carries its facts as fields. None holds a token or a payload."""

from __future__ import annotations


class StoreError(Exception):
    """Any error of a store; keyword arguments become fields."""

    def __init__(self, message: str = "", **fields):
        self.fields = fields
        for name, value in fields.items():
            setattr(self, name, value)
        super().__init__(message or ", ".join(f"{k}={v}" for k, v in fields.items()))


class StorageError(StoreError):
    """Files that are missing, unreadable or of another schema."""


class SchemaTooNew(StorageError):
    """found, supported"""


class ChecksumMismatch(StorageError):
    """version"""


class DuplicateEvent(StorageError):
    """An event id that is there already; the whole batch fails."""


class Invalid(StoreError):
    """Input that breaks a rule whatever the store holds, or names what it doesn't have."""


class Conflict(StoreError):
    """Input that doesn't fit what the store holds."""


class StreamVersionConflict(Conflict):
    """stream_id, expected, actual"""


class ProjectionVersionConflict(Conflict):
    """projection, expected, actual"""


class JobTransitionConflict(Conflict):
    """job_id, from_state, to_state"""


class LeaseConflict(Conflict):
    """job_id; reason: not_found, not_leased, invalid_token, expired or expiry_not_later"""


class DifferentContent(StoreError):
    """transaction_id: it was committed before with other content"""


class Indeterminate(StoreError):
    """transaction_id (and proposed job_ids of a claim): the outcome is unknown; recover_transaction or recover_claim tells it"""
