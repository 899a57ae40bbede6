"""The transactional face of the ledger: commits, claims, recovery and operations over a put-if-absent log."""

from tessera.store.core import Store
from tessera.store.model import CommitBatch, Event, JobSpec, Limits, ProjectionPatch, new_id

__all__ = ["CommitBatch", "Event", "JobSpec", "Limits", "ProjectionPatch", "Store", "new_id"]
