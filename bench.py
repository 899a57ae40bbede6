"""Times the headline queries, and the store's calls over a growing history; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time
from statistics import median

from tessera.plans import catalogue
from tessera.session import local_session
from tessera.store import CommitBatch, Event, JobSpec, Store

HEADLINE = (
    "claim_plan", "claim_maintenance", "assign_versions", "append_to_streams", "global_sequence", "transactions_rollup", "projection_state", "projection_after_clear", "projection_scan_prefix", "expected_version_conflicts",
    "resubmission_outcome", "fail_outcome", "lease_extension_outcome", "recover_claim", "verify_report", "verify_foreign_keys", "stats_counts", "export_events", "export_jobs",
)

#: Commits of 64 events and a job each, after which the store's calls are timed.
HISTORY = (64, 256)


def store_calls(spark) -> dict[str, float]:
    """Median seconds of a commit, a claim and its acknowledgement, a fold, and opening, by commits so far."""
    took = {}
    with tempfile.TemporaryDirectory(prefix="bench-store-") as folder:
        store, made = Store.open(spark, f"{folder}/s", durability="relaxed", checkpoint_every=32), 0

        def once() -> None:
            nonlocal made
            made += 1
            batch = CommitBatch(made.to_bytes(16, "big"), made)
            for k in range(64):
                batch.append_event(Event((made << 32 | k).to_bytes(16, "big"), f"stream {k}", "made", made, b"{}"))
            store.commit(batch.enqueue_job(JobSpec(made.to_bytes(16, "big"), "q", f"p{made % 8}", b"x")))

        def timed(call, times: int = 3) -> float:
            spans = []
            for _ in range(times):
                began = time.perf_counter()
                call()
                spans.append(time.perf_counter() - began)
            return round(median(spans), 3)

        def turn() -> None:
            batch = CommitBatch(os.urandom(16), made)
            for job in store.claim_jobs("q", "w", made, 1 << 40, 8)["jobs"]:
                batch.acknowledge_job(job["job_id"], job["lease_token"])
            store.commit(batch)

        for history in HISTORY:
            while made < history:
                once()
            for name, call in (("commit", once), ("claim_and_ack", turn), ("fold", lambda: (once(), store.checkpoint())), ("open", lambda: Store.open_existing(spark, f"{folder}/s"))):
                took[f"{name}_after_{history}"] = timed(call)
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cores=int(os.environ.get("BENCH_CPUS", "8")))
    took = {}
    for name in HEADLINE:
        query = catalogue.QUERIES[name]
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "ledger queries, second run each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "store": store_calls(spark), "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
