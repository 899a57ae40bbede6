import re

import duckdb
import pytest

from tessera.functions import states as S
from tessera.functions.columns import prefix_end
from tessera.plans import catalogue
from tessera.store.schemas import fnv1a_128

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def values(rows):
    return sorted((tuple(float(v) if type(v) in (int, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    made = catalogue.QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    told = duck.sql(catalogue.ORACLE[name])
    assert sorted(told.columns) == columns
    assert values(map(tuple, made.select(*columns).collect())) == values(told.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_prefix_ends():
    cases = {b"ab": b"ac", b"\x01\xff": b"\x02", b"\x01\xff\xff": b"\x02", b"\xff": None, b"\xff\xff": None, b"": None}
    assert {k: prefix_end(k) for k in cases} == cases


def test_thirteen_transitions():
    legal = {(a, b) for a in range(7) for b in range(7) if S.allowed(a, b)}
    assert len(legal) == 13 and not any(a in S.TERMINAL for a, _ in legal)


def test_fnv_vectors():
    assert fnv1a_128(b"").hex() == "6c62272e07bb014262b821756295c58d" and fnv1a_128(b"a").hex() == "d228cb696f1a8caf78912b704e4a8964"


def test_command_line(spark, tmp_path, capsys):
    from tessera import cli
    from tessera.store import CommitBatch, Event, JobSpec, Store

    path = str(tmp_path / "s")
    store = Store.open(spark, path)
    store.commit(CommitBatch(bytes([1] * 16), 1).append_event(Event(bytes([2] * 16), "s", "t", 1)).enqueue_job(JobSpec(bytes([3] * 16), "q", "p")))
    assert cli.main([path, "nonsense"], spark) == cli.USAGE and cli.main([str(tmp_path / "none"), "stats"], spark) == cli.FAILED
    assert cli.main(["store", path, "events", "stream", "none"], spark) == cli.NOT_FOUND
    assert cli.main([path, "jobs", "list", "--limit", "1"], spark) == cli.DONE and "next: --after 1" in capsys.readouterr().out
    assert cli.main([path, "doctor"], spark) == cli.DONE
    assert cli.main([path, "jobs", "resolve", "03" * 16, "dead"], spark) == cli.FAILED


def test_following_a_table_commits_each_batch_once(spark, tmp_path):
    from tessera.store import CommitBatch, Event, Store
    from tessera.streaming.tail import follow, tail, transaction_id

    source = str(tmp_path / "in")
    spark.range(5).selectExpr("id", "'s' as stream").coalesce(1).write.parquet(source)
    store = Store.open(spark, str(tmp_path / "s"), durability="relaxed")

    def handle(batch, batch_id):
        made = CommitBatch(transaction_id("q", batch_id), batch_id)
        for r in batch.orderBy("id").collect():
            made.append_event(Event(r["id"].to_bytes(16, "big", signed=False) if r["id"] else bytes([9] * 16), r["stream"], "t", 1))
        store.commit(made)
        store.commit(made)

    rows = tail(spark, source, spark.read.parquet(source).schema)
    follow(rows, handle, str(tmp_path / "c")).awaitTermination()
    follow(rows, handle, str(tmp_path / "c")).awaitTermination()
    assert store.stream_version("s") == 5


def test_a_hot_key_is_cut_at_its_ties(spark):
    """Nine of ten rows have one key; numbers stay exact, and no range holds more than a part of them."""
    from pyspark.sql import functions as F

    from tessera.functions.numbering import global_sequence, quantiles

    rows = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(700).alias("key"), (F.col("id") * 7919 % 2000).alias("tie"))
    got = global_sequence(rows, "n", "key", "tie").collect()
    assert [r["n"] for r in sorted(got)] == list(range(1, 2001))
    assert quantiles(rows, "key", 4).count(700) >= 2
    plan = global_sequence(rows, "n", "key", "tie")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"tie#\d+L >= ", plan)


def test_digests_of_rows_are_those_of_batches(spark):
    from tessera.operators.events import expectation_digest
    from tessera.store import CommitBatch

    rows = [(n, 1000 + n, bytes([n]) * n, f"stream-é{n}", n * 3) for n in range(5)]
    got = {r[0]: r[1] for r in expectation_digest(spark.createDataFrame(rows, "transaction_id long, committed_at_ms long, metadata binary, stream_id string, expected long")).collect()}
    for n, at, metadata, stream, version in rows:
        assert got[n] == CommitBatch(bytes([1] * 16), at, metadata=metadata).expect_stream_version(stream, version).digest().hex()


def test_point_reads_filter_in_the_scan(spark):
    plan = catalogue.QUERIES["projection_get"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,3-MEDIUM)" in plan and "Window" not in plan
