"""Random operations against a model in plain Python, and folds over a growing history."""

import random

import pytest

from tessera.functions import states as S
from tessera.store import CommitBatch, Event, JobSpec, ProjectionPatch, Store
from tessera.store import fold as folding
from tessera.store.errors import JobTransitionConflict, ProjectionVersionConflict, StreamVersionConflict


def i(n):
    return n.to_bytes(16, "big")


class Model:
    """What a store should hold."""

    def __init__(self):
        self.events, self.versions, self.entries, self.patches, self.jobs, self.cursor = [], {}, {}, {}, {}, None

    def leasable(self, limit):
        """Heads that may be leased, round robin after the cursor."""
        heads = {}
        for job_id, job in self.jobs.items():  # in enqueue order
            if job["state"] in S.ACTIVE:
                heads.setdefault(job["partition"], job_id)
        free = [p for p, j in heads.items() if self.jobs[j]["state"] == S.PENDING]
        turn = sorted(free, key=lambda p: (self.cursor is not None and p <= self.cursor, p))[:limit]
        return [heads[p] for p in turn]


@pytest.mark.parametrize("seed", [0xA11CE, 0xB0B])
def test_random_operations_match_a_model(spark, tmp_path, seed):
    rng, model, tokens = random.Random(seed), Model(), {}
    path = str(tmp_path / "s")
    store = Store.open(spark, path, durability="relaxed", checkpoint_every=3)
    for step in range(1, 46):
        kind = rng.choice(("event", "event", "wrong", "patch", "clear", "enqueue", "claim", "end", "cancel", "open"))
        batch, name = CommitBatch(i(step), step), rng.choice(("x", "y", "z"))
        if kind == "event":
            for k in range(rng.randint(1, 3)):
                batch.append_event(Event(i(1000 * step + k), name, "made", step, b"{}"))
                model.versions[name] = model.versions.get(name, 0) + 1
                model.events.append((i(1000 * step + k), name, model.versions[name]))
            store.commit(batch)
        elif kind == "wrong":
            with pytest.raises(StreamVersionConflict):
                store.commit(batch.expect_stream_version(name, model.versions.get(name, 0) + 1).append_event(Event(i(1000 * step), name, "made", step, b"{}")))
            with pytest.raises(ProjectionVersionConflict):
                store.commit(CommitBatch(i(step), step).apply_projection_patch(ProjectionPatch(name, model.patches.get(name, 0) + 1).put(b"no", b"")))
        elif kind in ("patch", "clear"):
            patch = ProjectionPatch(name, model.patches.get(name, 0))
            if kind == "clear":
                patch.clear()
                model.entries = {k: v for k, v in model.entries.items() if k[0] != name}
            for key in rng.sample(range(6), 2):
                if rng.random() < 0.3:
                    patch.delete(bytes([key]))
                    model.entries.pop((name, bytes([key])), None)
                else:
                    patch.put(bytes([key]), b"%d" % step)
                    model.entries[name, bytes([key])] = b"%d" % step
            model.patches[name] = model.patches.get(name, 0) + 1
            store.commit(batch.apply_projection_patch(patch))
        elif kind == "enqueue":
            for k in range(2):
                model.jobs[i(1000 * step + k)] = {"state": S.PENDING, "partition": name, "attempt": 0}
                batch.enqueue_job(JobSpec(i(1000 * step + k), "q", name, b"x"))
            store.commit(batch)
        elif kind == "claim":
            limit = rng.randint(1, 3)
            want = model.leasable(limit)
            got = store.claim_jobs("q", "w", step, 1 << 40, limit)
            assert [j["job_id"] for j in got["jobs"]] == want
            for job in got["jobs"]:
                tokens[job["job_id"]] = job["lease_token"]
                model.jobs[job["job_id"]].update(state=S.LEASED, attempt=job["attempt"])
                model.cursor = job["partition_key"]
        elif kind == "end" and tokens:
            job_id, token = tokens.popitem()
            if rng.random() < 0.5:  # the receipt of a lease that began before the last fold follows the job
                assert store.extend_lease(job_id, token, (1 << 41) + step, step)["job_id"] == job_id
            store.commit(batch.acknowledge_job(job_id, token))
            model.jobs[job_id]["state"] = S.SUCCEEDED
            with pytest.raises(JobTransitionConflict):
                store.commit(CommitBatch(i(500 + step), step).acknowledge_job(job_id, token))
        elif kind == "cancel" and (pending := [j for j, job in model.jobs.items() if job["state"] == S.PENDING]):
            job_id = rng.choice(pending)
            store.commit(batch.cancel_job(job_id))
            model.jobs[job_id]["state"] = S.CANCELLED
        elif kind == "open":
            store = Store.open(spark, path, durability="relaxed", checkpoint_every=3)
    again = Store.open_existing(spark, path)
    for s in (store, again):
        assert [(e["event_id"], e["stream_id"], e["stream_version"]) for e in s.events_after(0, None)] == model.events
        assert [e["global_sequence"] for e in s.events_after(0, None)] == list(range(1, len(model.events) + 1))
        assert [(j["job_id"], j["state"], j["attempt"]) for j in s.jobs("q")] == [(k, v["state"], v["attempt"]) for k, v in model.jobs.items()]
        for name in ("x", "y", "z"):
            assert s.projection_scan_prefix(name, b"", None) == sorted((k[1], v) for k, v in model.entries.items() if k[0] == name)
            assert s.projection_version(name) == model.patches.get(name, 0) and s.stream_version(name) == model.versions.get(name, 0)
    assert store.fold_error is None and again.verify() == []


def test_folds_link_what_cannot_change(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), durability="relaxed", checkpoint_every=0)
    inodes = []
    for n in range(1, folding.MERGE + 2):
        store.commit(CommitBatch(i(n), n).append_event(Event(i(n), "s", "made", n, b"{}")).enqueue_job(JobSpec(i(n), "q", "p", b"x")))
        if n > 1:
            store.commit(CommitBatch(i(100 + n), n).cancel_job(i(n - 1)))
        store.checkpoint()
        inodes.append({f.stat().st_ino for p in store._snapshot.parts("events") for f in p.glob("*.parquet")})
    assert all(a < b for a, b in zip(inodes[: folding.MERGE - 2], inodes[1:]))  # linked, and one part more
    assert [p.name[:2] for p in store._snapshot.parts("events")] == ["00", "01"] and len(inodes[-1]) == 2
    assert [j["job_id"] for j in store._snapshot.stored("jobs", live=True).collect()] == [bytearray(i(folding.MERGE + 1))]
    assert store._snapshot.stored("jobs", live=False).count() == folding.MERGE
    read = store._snapshot.table("jobs", live=True).inputFiles()
    assert read and all("/jobs/live/" in f for f in read)  # a claim reads no job that had ended
    assert [e["event_id"] for e in store.events_after(0, None)] == [i(n) for n in range(1, folding.MERGE + 2)] and store.verify() == []
    before = inodes[-1]
    store.commit(CommitBatch(i(500), 1).apply_projection_patch(ProjectionPatch("p", 0).put(b"a", b"1")))
    store.checkpoint()
    assert {f.stat().st_ino for p in store._snapshot.parts("events") for f in p.glob("*.parquet")} == before  # no events, nothing written


def test_a_fold_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    store = Store.open(spark, str(tmp_path / "s"), durability="relaxed", checkpoint_every=0)
    store.commit(CommitBatch(i(1), 1).append_event(Event(i(1), "s", "made", 1, b"{}")))
    store.checkpoint()
    folders = sorted((tmp_path / "s" / "tables").iterdir())

    def gone(*a):
        raise FileNotFoundError

    monkeypatch.setattr("os.link", gone)
    with pytest.raises(FileNotFoundError):
        folding.fold(store._snapshot, str(tmp_path / "aside"))
    with pytest.raises(FileNotFoundError):
        store.checkpoint()
    assert sorted((tmp_path / "s" / "tables").iterdir()) == folders and store.verify() == []
