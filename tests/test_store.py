import hashlib
import threading

import pytest

from tessera.functions import states as S
from tessera.store import CommitBatch, Event, JobSpec, Limits, ProjectionPatch, Store
from tessera.store.errors import DifferentContent, DuplicateEvent, Indeterminate, Invalid, JobTransitionConflict, LeaseConflict, ProjectionVersionConflict, StorageError, StreamVersionConflict


def i(n):
    return n.to_bytes(16, "big")


def event(n, stream="s", payload=b"{}"):
    return Event(i(n), stream, "made", 1000, payload)


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, str(tmp_path / "store"), durability="relaxed", checkpoint_every=5)


def test_events_versions_and_resubmission(store, spark):
    batch = CommitBatch(i(1), 2000).expect_stream_version("s", 0).append_event(event(1)).append_event(event(2)).append_event(event(3, "t"))
    first = store.commit(batch)
    assert first["transaction_sequence"] == 1 and first["operation_count"] == 3
    assert store.commit(batch) == first
    assert [(e["stream_id"], e["stream_version"], e["global_sequence"]) for e in store.events_after(0, None)] == [("s", 1, 1), ("s", 2, 2), ("t", 1, 3)]
    with pytest.raises(DifferentContent):
        store.commit(CommitBatch(i(1), 2001))
    with pytest.raises(StreamVersionConflict) as e:
        store.commit(CommitBatch(i(2), 2000).expect_stream_version("s", 1))
    assert (e.value.expected, e.value.actual) == (1, 2)
    with pytest.raises(DuplicateEvent):
        store.commit(CommitBatch(i(3), 2000).append_event(event(9)).append_event(event(1)))
    assert store.get_event(i(9)) is None and store.stream_version("s") == 2 and store.stream_version("none") == 0
    assert [e["event_id"] for e in store.last_events(2)] == [i(2), i(3)]
    assert store.events_after(0, 0) == []
    assert store.stats()["events"] == 3 and store.verify() == []


def test_projections_survive_checkpoints(store, spark):
    store.commit(CommitBatch(i(1), 1).apply_projection_patch(ProjectionPatch("p", 0).put(b"a", b"1").put(b"\xff", b"2").put(b"\xff\x01", b"3")))
    store.checkpoint()
    store.commit(CommitBatch(i(2), 2).apply_projection_patch(ProjectionPatch("p", 1).delete(b"a").put(b"b", b"4")))
    assert store.projection_scan_prefix("p", b"\xff", None) == [(b"\xff", b"2"), (b"\xff\x01", b"3")]
    assert store.projection_scan_range("p", None, b"\xff", None, None) == [(b"b", b"4")]
    assert store.projection_get("p", b"a") is None and store.projection_get("p", b"\xff") == b"2"
    both = CommitBatch(i(3), 3).apply_projection_patch(ProjectionPatch("p", 2).put(b"c", b"5").clear().put(b"d", b"6")).apply_projection_patch(ProjectionPatch("p", 3).put(b"e", b"7"))
    store.commit(both)
    assert store.projection_scan_prefix("p", b"", None) == [(b"d", b"6"), (b"e", b"7")] and store.projection_version("p") == 4
    again = Store.open_existing(spark, str(store.path))
    assert again.projection_entry_count("p") == 2
    with pytest.raises(ProjectionVersionConflict):
        store.commit(CommitBatch(i(4), 4).apply_projection_patch(ProjectionPatch("p", 2)))
    for bad in (ProjectionPatch("p", 4).put(b"k", b"").delete(b"k"), ProjectionPatch("p", 4).replace([(b"k", b""), (b"k", b"")]), ProjectionPatch("p", 4).replace([(b"k", b"")]).put(b"k", b"")):
        with pytest.raises(Invalid):
            store.commit(CommitBatch(i(5), 4).apply_projection_patch(bad))
    store.commit(CommitBatch(i(6), 4).apply_projection_patch(ProjectionPatch("p", 4).put(b"k", b"1").clear().put(b"k", b"2")))
    with pytest.raises(StorageError):
        again.commit(CommitBatch(i(7), 4))


def enqueue(store, *jobs):
    batch = CommitBatch(i(900 + jobs[0][0]), 1000)
    for n, partition, *more in jobs:
        batch.enqueue_job(JobSpec(i(n), "q", partition, b"x", **(more[0] if more else {})))
    store.commit(batch)


def claim(store, now=2000, limit=10, lease=10_000):
    return store.claim_jobs("q", "w", now, lease, limit)


def test_round_robin_and_head_of_line(store):
    enqueue(store, (1, "a"), (2, "b"), (3, "c"), (4, "a"), (5, "b"), (6, "c"))
    seen = []
    for n in range(4):
        got = claim(store, limit=1)
        seen.append(got["jobs"][0]["partition_key"])
        store.commit(CommitBatch(i(100 + n), 2000).acknowledge_job(got["jobs"][0]["job_id"], got["jobs"][0]["lease_token"]))
    assert seen == ["a", "b", "c", "a"]
    assert {j["job_id"] for j in claim(store)["jobs"]} == {i(5), i(6)}
    assert claim(store)["kind"] == "noop"
    assert store.stats()["jobs_by_state"] == {"succeeded": 4, "leased": 2} and store.verify() == []


def test_expiry_maintenance_and_recovery(store):
    enqueue(store, (1, "a", {"max_attempts": 1, "effect_mode": S.IDEMPOTENT}), (2, "a"), (3, "b"))
    first = claim(store)
    tokens = {j["job_id"]: j["lease_token"] for j in first["jobs"]}
    assert claim(store, now=12_000)["kind"] == "noop"
    assert {j["job_id"] for j in store.recover_claim(first["transaction_id"], 12_000)["jobs"]} == {i(1), i(3)}
    assert store.recover_claim(first["transaction_id"], 12_001)["stale_jobs"] == [i(1), i(3)]
    with pytest.raises(LeaseConflict) as e:
        store.extend_lease(i(1), tokens[i(1)], 12_000, 12_000)
    assert e.value.reason == "expiry_not_later"
    for job_id, token, now, reason in ((i(9), i(1), 0, "not_found"), (i(2), i(1), 0, "not_leased"), (i(1), i(1), 0, "invalid_token"), (i(1), tokens[i(1)], 12_001, "expired")):
        with pytest.raises(LeaseConflict) as e:
            store.extend_lease(job_id, token, 20_000, now)
        assert e.value.reason == reason
    assert claim(store, now=20_000)["kind"] == "maintenance_committed"
    assert store.job(i(1))["state"] == S.DEAD and store.job(i(1))["error_summary"] == "lease expired at final attempt" and store.job(i(3))["state"] == S.UNCERTAIN
    assert store.stats()["oldest_uncertain_job_ms"] == 20_000
    assert [j["job_id"] for j in claim(store, now=20_000)["jobs"]] == [i(2)]
    store.commit(CommitBatch(i(50), 20_001).resolve_uncertain_job(i(3), "retry"))
    again = claim(store, now=20_002)["jobs"][0]
    assert (again["job_id"], again["attempt"]) == (i(3), 2)
    assert store.recover_claim(i(77), 0)["kind"] == "absent" and store.recover_claim(i(50), 0)["kind"] == "maintenance_committed"


def test_transitions(store):
    enqueue(store, (1, "a"), (2, "b"), (3, "c"))
    for op in (lambda b: b.acknowledge_job(i(1), i(5)), lambda b: b.fail_job(i(1), i(5), "x"), lambda b: b.resolve_uncertain_job(i(1), "dead")):
        with pytest.raises(JobTransitionConflict):
            store.commit(op(CommitBatch(i(60), 2000)))
    with pytest.raises(Invalid):
        store.commit(CommitBatch(i(61), 2000).cancel_job(i(1), i(5)))
    store.commit(CommitBatch(i(62), 2000).cancel_job(i(1)))
    leased = {j["job_id"]: j for j in claim(store)["jobs"]}
    with pytest.raises(Invalid):
        store.commit(CommitBatch(i(63), 2000).cancel_job(i(2)))
    store.commit(CommitBatch(i(64), 2000).fail_job(i(2), leased[i(2)]["lease_token"], "broke", 5000))
    with pytest.raises(JobTransitionConflict):
        store.commit(CommitBatch(i(65), 2000).cancel_job(i(2)))
    assert claim(store, now=4000)["kind"] == "noop"
    assert claim(store, now=5000)["jobs"][0]["attempt"] == 2
    with pytest.raises(Invalid):
        store.commit(CommitBatch(i(66), (1 << 63) - 1).fail_job(i(3), leased[i(3)]["lease_token"], "late"))
    store.commit(CommitBatch(i(67), (1 << 63) - 1 - 30_000).fail_job(i(3), leased[i(3)]["lease_token"], "late"))
    assert store.job(i(3))["retry_after_ms"] == (1 << 63) - 1
    page, cursor = store.jobs_page("q", None, 0, 2)
    assert [j["job_id"] for j in page] == [i(1), i(2)] and store.jobs_page("q", None, 3, 2) == ([], 3) and cursor == 2
    with pytest.raises(Invalid):
        store.jobs_page(None, None, 1 << 63, 1)


def test_unknown_outcome(store):
    store.fail_next_commit()
    batch = CommitBatch(i(1), 1).append_event(event(1))
    with pytest.raises(Indeterminate):
        store.commit(batch)
    assert store.recover_transaction(i(1))["kind"] == "committed" and store.recover_transaction(i(2))["kind"] == "absent"
    assert store.commit(batch)["transaction_sequence"] == 1


def test_threads_leave_no_gap(store, spark):
    other = Store.open(spark, str(store.path), durability="relaxed", checkpoint_every=0)

    def work(s, k):
        for n in range(4):
            s.commit(CommitBatch(i(k * 10 + n), 1).append_event(event(k * 10 + n)))

    threads = [threading.Thread(target=work, args=(s, k)) for k, s in ((1, store), (2, other), (3, store))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [e["stream_version"] for e in store.events_after(0, None)] == list(range(1, 13))


def test_limits_and_digest():
    with pytest.raises(Invalid):
        Limits(operations=0)
    with pytest.raises(Invalid):
        CommitBatch(i(1), 1, metadata=b"x" * (65 << 10)).check(Limits())
    with pytest.raises(Invalid):
        CommitBatch(bytes(16), 1).check(Limits())
    a, b = CommitBatch(i(1), 1).expect_stream_version("ab", 1), CommitBatch(i(2), 1).expect_stream_version("a", 1)
    assert a.digest() != b.digest() and CommitBatch(i(3), 1).digest() == CommitBatch(i(4), 1).digest()
    empty = (1).to_bytes(8, "big") + b"\0" + bytes(8) + bytes(8) + bytes(8)
    assert CommitBatch(i(3), 1).digest() == hashlib.sha256(empty).digest()


def test_export_and_backup(store, spark, tmp_path):
    store.commit(CommitBatch(i(1), 2000).append_event(event(1, "s1", b'{"a":1}')).append_event(event(2, "s1")).append_event(event(3, "s2")))
    lines = [r["value"] for r in store.diagnostic_export().collect()]
    assert len(lines) == 8 and not any("7b2261223a317d" in x for x in lines)
    assert any("7b2261223a317d" in r["value"] for r in store.diagnostic_export(True).collect())
    store.backup(str(tmp_path / "copy"))
    with pytest.raises(StorageError):
        store.backup(str(tmp_path / "copy"))
    assert Store.open_existing(spark, str(tmp_path / "copy")).stats()["events"] == 3


def many(store, n, start=1):
    for k in range(start, start + n):
        store.commit(CommitBatch(i(k), k).append_event(event(k)))


def test_a_missing_marker_is_found_and_nothing_is_written_over_it(spark, tmp_path):
    path = tmp_path / "s"
    many(Store.open(spark, str(path), durability="relaxed", checkpoint_every=0), 6)
    (path / "log" / f"{4:020d}.json").unlink()
    again = Store.open(spark, str(path), durability="relaxed", checkpoint_every=0)
    assert ("integrity_check", "markers 4 to 4 are missing") in again.verify()
    with pytest.raises(StorageError):
        again.commit(CommitBatch(i(50), 1).append_event(event(50)))
    assert not (path / "log" / f"{4:020d}.json").exists()


def test_a_marker_of_another_history_is_refused(spark, tmp_path):
    import shutil

    for name in ("a", "b"):
        many(Store.open(spark, str(tmp_path / name), durability="relaxed", checkpoint_every=0), 3, 1 if name == "a" else 100)
    shutil.copy(tmp_path / "b" / "log" / f"{3:020d}.json", tmp_path / "a" / "log" / f"{3:020d}.json")
    with pytest.raises(StorageError, match="does not follow"):
        Store.open_existing(spark, str(tmp_path / "a"))


def test_folds_are_checked_and_old_ones_go(spark, tmp_path):
    import shutil

    path = tmp_path / "s"
    store = Store.open(spark, str(path), durability="relaxed", checkpoint_every=2)
    many(store, 8)
    assert len(list((path / "folds").glob("*.json"))) == 2 and len(list((path / "tables").iterdir())) == 2
    assert store.log.numbers() == [7, 8] and store.verify() == [] and store.fold_error is None
    again = Store.open_existing(spark, str(path))
    assert [e["event_id"] for e in again.events_after(0, None)] == [i(k) for k in range(1, 9)]
    newest = sorted((path / "tables").iterdir())[-1]
    shutil.rmtree(newest / "streams")
    assert ("integrity_check", "fold 8: streams has no table, not 1 rows") in store.verify()


def test_disk_errors_are_typed(spark, tmp_path, monkeypatch):
    store = Store.open(spark, str(tmp_path / "s"), durability="strict", checkpoint_every=0)

    def fail(self):
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr("tessera.store.log.Log.settle", fail)
        with pytest.raises(Indeterminate):
            store.commit(CommitBatch(i(1), 1).append_event(event(1)))
    assert store.recover_transaction(i(1))["kind"] == "committed"
    with monkeypatch.context() as m:
        m.setattr("os.link", lambda *a: fail(None))
        with pytest.raises(StorageError):
            store.commit(CommitBatch(i(2), 1).append_event(event(2)))
    assert store.recover_transaction(i(2))["kind"] == "absent"
    with monkeypatch.context() as m:
        m.setattr(Store, "checkpoint", fail)
        store.checkpoint_every = 1
        store.commit(CommitBatch(i(3), 1).append_event(event(3)))
        assert isinstance(store.fold_error, OSError)
    store.commit(CommitBatch(i(4), 1).append_event(event(4)))
    assert store.fold_error is None and store.stream_version("s") == 3 and store.verify() == []


def test_a_killed_writer_leaves_whole_commits(spark, tmp_path):
    """A writer that dies between writing aside and linking leaves nothing that counts."""
    path = tmp_path / "s"
    store = Store.open(spark, str(path), durability="relaxed", checkpoint_every=0)
    many(store, 2)
    (path / "log" / ".aside").write_text('{"kind": "com')
    again = Store.open(spark, str(path), durability="relaxed", checkpoint_every=0)
    many(again, 1, 3)
    assert again.stream_version("s") == 3 and again.verify() == []


def test_a_changed_checksum_is_reported(spark, tmp_path):
    import json

    from tessera import cli
    from tessera.store.errors import ChecksumMismatch

    path = tmp_path / "s"
    many(Store.open(spark, str(path), durability="relaxed"), 1)
    record = path / "schema.json"
    record.write_text(json.dumps(json.loads(record.read_text()) | {"checksum": "00"}))
    found = Store.open_existing(spark, str(path)).verify()
    assert {c for c, _ in found} == {"migrations", "migration_checksums"} and cli.main([str(path), "verify"], spark) == cli.FINDINGS
    with pytest.raises(ChecksumMismatch):
        Store.open(spark, str(path))


def test_replace_and_export_order(store, spark):
    import json

    batch = CommitBatch(i(1), 1)
    for n, stream in enumerate(("a!", "a", "a 1", 'a"', "é", "b"), 1):
        batch.append_event(event(n, stream))
    store.commit(batch.apply_projection_patch(ProjectionPatch("p", 0).put(b"\xff", b"1").put(b"\x80a", b"2").put(b"a", b"3")))
    lines = [json.loads(r["value"]) for r in store.diagnostic_export().collect()]
    assert lines[0] == {"kind": "header", "format": "tessera-diagnostic-v1", "restorable": False, "schema_version": 1, "payloads_included": False}
    assert lines[1]["kind"] == "stats" and lines[1]["events"] == 6 and lines[1]["projection_entries"] == 3 and lines[1]["jobs_by_state"] == {}
    assert [x["stream_id"] for x in lines if x["kind"] == "stream"] == ["a", "a 1", "a!", 'a"', "b", "é"]
    assert [(x["key_hex"], x["value_len"]) for x in lines if x["kind"] == "projection_entry"] == [("61", 1), ("8061", 1), ("ff", 1)]
    store.commit(CommitBatch(i(2), 2).apply_projection_patch(ProjectionPatch("p", 1).replace([(b"x", b"9"), (b"y", b"8")])))
    assert store.projection_scan_prefix("p", b"", None) == [(b"x", b"9"), (b"y", b"8")] and store.projection_version("p") == 2
    store.commit(CommitBatch(i(3), 3).expect_stream_version("new", 0))
    assert store.stats()["streams"] == 7 and store.stream_version("new") == 0
