"""The registered queries of the ledger and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import hexed
from tessera.operators import events, export, jobs, projections, recovery, stats, verify
from tessera.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The SQL of each query without its views.
SQL: dict[str, str] = {}

#: 1999-01-01, the time at which plans are made.
NOW = 915_148_800_000

#: The views of tessera.sources.views in SQL, in an order in which each may use those before it.
VIEWS = {
    "ev": """SELECT event_id, user_id, 'user:' || user_id AS stream_id, event_type, epoch_us(ts) // 1000 AS occurred_at_ms, props AS payload,
        row_number() OVER (ORDER BY ts, event_id) AS global_sequence, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stream_version,
        (row_number() OVER (ORDER BY ts, event_id) - 1) // 4 + 1 AS transaction_sequence FROM events""",
    "tx": "SELECT transaction_sequence, max(occurred_at_ms) AS committed_at_ms, count(*) AS operation_count FROM ev GROUP BY 1",
    "st": "SELECT stream_id, max(stream_version) AS current_version FROM ev GROUP BY 1",
    "jb": """SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS enqueue_sequence, o_orderpriority AS queue, 'cust:' || o_custkey AS partition_key,
        epoch_us(o_orderdate) // 1000 AS not_before_ms, 3 AS max_attempts, (o_orderkey // 7) % 2 AS effect_mode, o_orderkey % 7 AS state,
        CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 3 + 1 END AS attempt, CASE WHEN o_orderkey % 7 = 1 THEN 'w' || (o_orderkey % 8) END AS worker_id,
        CASE WHEN o_orderkey % 7 = 1 THEN epoch_us(o_orderdate) // 1000 + 60000 * (o_orderkey % 1000) END AS lease_expires_at_ms,
        CASE WHEN o_orderkey % 7 = 2 THEN epoch_us(o_orderdate) // 1000 + 30000 END AS retry_after_ms,
        CASE WHEN o_orderkey % 7 >= 4 THEN epoch_us(o_orderdate) // 1000 + 1000 END AS terminal_at_ms FROM orders""",
    "jt": "SELECT *, CASE WHEN state = 1 THEN job_id * 7 + 1 END AS lease_token FROM jb",
    "pc": """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, o_orderpriority AS projection, 'cust:' || o_custkey AS key, o_totalprice AS value,
        CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'put' END AS op FROM orders""",
    "pe": "SELECT projection, key, value FROM (SELECT *, row_number() OVER (PARTITION BY projection, key ORDER BY seq DESC) AS r FROM pc) WHERE r = 1 AND op = 'put'",
    "pv": "SELECT projection, count(*) AS version FROM pc GROUP BY 1",
    "rc": "SELECT l_linenumber::BIGINT AS transaction_id, l_orderkey AS job_id, min(l_suppkey) AS lease_token, l_orderkey % 3 + 1 AS attempt FROM lineitem GROUP BY 1, 2, 4",
}
NEEDS = {"tx": ["ev"], "st": ["ev"], "jt": ["jb"], "pe": ["pc"], "pv": ["pc"]}
EVENT = ["global_sequence", "event_id", "stream_id", "event_type", "occurred_at_ms", "payload", "transaction_sequence"]
JOB = ["enqueue_sequence", "job_id", "queue", "partition_key", "not_before_ms", "max_attempts", "effect_mode", "state", "attempt", "worker_id", "lease_expires_at_ms", "retry_after_ms", "terminal_at_ms"]
#: Cursors of the queues when claims are planned.
CURSORS = {"1-URGENT": "cust:500", "2-HIGH": "cust:1", "3-MEDIUM": "cust:99"}


def query(name: str, uses: str, sql: str):
    """Registers a query with its SQL over the views named in uses."""

    def register(f):
        wanted = {v for u in uses.split() for v in [u, *NEEDS.get(u, [])]}
        prelude = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in wanted)
        SQL[name] = sql
        QUERIES[name], ORACLE[name] = f, f"WITH {prelude} {sql}" if prelude else sql.replace(", ", "WITH ", 1) if sql.startswith(",") else sql
        return f

    return register


def leased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs (without enqueue_sequence) with a lease_token."""
    return views.jobs(spark, sf_dir, ordered=False).withColumn("lease_token", F.when(F.col("state") == 1, F.col("job_id") * 7 + 1))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.state(views.changes(spark, sf_dir))


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", hexed("key"))


@query("events_after", "ev", f"SELECT {', '.join(EVENT)} FROM ev WHERE global_sequence > 5000 ORDER BY global_sequence LIMIT 256")
def events_after(spark, d):
    return events.events_after(views.sequenced(spark, d), 5000, 256).select(*EVENT)


@query("stream_events", "ev", "SELECT stream_id, stream_version, event_id, event_type, occurred_at_ms, payload FROM ev WHERE stream_id = 'user:13' AND stream_version >= 5 ORDER BY stream_version LIMIT 100")
def stream_events(spark, d):
    return events.stream_events(views.versioned(spark, d), "user:13", 5, 100).select("stream_id", "stream_version", "event_id", "event_type", "occurred_at_ms", "payload")


@query("last_events", "ev", f"SELECT {', '.join(EVENT)} FROM (SELECT * FROM ev ORDER BY global_sequence DESC LIMIT 10) ORDER BY global_sequence")
def last_events(spark, d):
    return events.last_events(views.sequenced(spark, d), 10).select(*EVENT)


@query("get_event", "ev", "SELECT event_id, stream_id, event_type, occurred_at_ms, payload FROM ev WHERE event_id = 77")
def get_event(spark, d):
    return events.get_event(views.event_rows(spark, d), 77).select("event_id", "stream_id", "event_type", "occurred_at_ms", "payload")


@query("stream_version", "st", "SELECT coalesce(max(current_version), 0) AS current_version FROM st WHERE stream_id = 'user:13'")
def stream_version(spark, d):
    return events.stream_version(views.streams(spark, d), "user:13")


@query("stream_version_absent", "st", "SELECT coalesce(max(current_version), 0) AS current_version FROM st WHERE stream_id = 'user:none'")
def stream_version_absent(spark, d):
    return events.stream_version(views.streams(spark, d), "user:none")


@query("assign_versions", "ev", "SELECT event_id, stream_id, stream_version FROM ev")
def assign_versions(spark, d):
    """All events as one batch onto an empty store."""
    empty = spark.createDataFrame([], "stream_id string, current_version long")
    return events.assign_versions(views.event_rows(spark, d), empty, ["ts", "event_id"]).select("event_id", "stream_id", "stream_version")


@query("append_to_streams", "ev st", "SELECT event_id + 1000000 AS event_id, stream_id, stream_version + current_version AS stream_version FROM ev JOIN st USING (stream_id) WHERE user_id % 3 = 0")
def append_to_streams(spark, d):
    """A batch that repeats the events of some streams, numbered above what those have."""
    batch = views.event_rows(spark, d).where("user_id % 3 = 0").withColumn("event_id", F.col("event_id") + 1_000_000)
    return events.assign_versions(batch, views.streams(spark, d), ["ts", "event_id"]).select("event_id", "stream_id", "stream_version")


@query("global_sequence", "ev", "SELECT event_id, global_sequence, transaction_sequence FROM ev")
def global_sequence(spark, d):
    return views.sequenced(spark, d).select("event_id", "global_sequence", "transaction_sequence")


@query("transactions_rollup", "tx", "SELECT transaction_sequence, committed_at_ms, operation_count FROM tx")
def transactions_rollup(spark, d):
    return views.transactions(spark, d)


@query("expected_version_conflicts", "st", "SELECT stream_id, e AS expected, coalesce(current_version, 0) AS actual FROM (SELECT DISTINCT 'user:' || user_id AS stream_id, user_id % 100 AS e FROM events UNION ALL SELECT 'user:none', 3) LEFT JOIN st USING (stream_id) WHERE e <> coalesce(current_version, 0)")
def expected_version_conflicts(spark, d):
    wanted = views.event_rows(spark, d).select("stream_id", (F.col("user_id") % 100).alias("expected")).distinct()
    absent = spark.range(1).select(F.lit("user:none").alias("stream_id"), F.lit(3).cast("long").alias("expected"))
    return events.expected_version_conflicts(wanted.unionByName(absent), views.streams(spark, d))


@query("duplicate_event_ids", "", "SELECT event_id, count(*) AS copies FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE user_id % 5 = 0) GROUP BY 1 HAVING count(*) > 1")
def duplicate_event_ids(spark, d):
    rows = views.event_rows(spark, d)
    return events.duplicate_event_ids(rows.where("user_id % 5 = 0"), rows)


@query("resubmission_outcome", "", """SELECT n.event_id AS transaction_id, CASE WHEN o.event_id IS NULL THEN 'new' WHEN sha256(o.props) = sha256(n.p) THEN 'same' ELSE 'different' END AS outcome
    FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN props ELSE props || '!' END AS p FROM events) n LEFT JOIN (SELECT event_id, props FROM events WHERE event_id % 3 <> 0) o USING (event_id)""")
def resubmission_outcome(spark, d):
    rows = views.event_rows(spark, d).select(F.col("event_id").alias("transaction_id"), "user_id", "payload")
    again = rows.select("transaction_id", F.sha2(F.when(F.col("user_id") % 2 == 0, F.col("payload")).otherwise(F.concat("payload", F.lit("!"))), 256).alias("digest"))
    return events.resubmission_outcome(again, rows.where("transaction_id % 3 <> 0").select("transaction_id", F.sha2("payload", 256).alias("digest")))


@query("projection_state", "pe", "SELECT projection, lower(hex(key)) AS key, value FROM pe")
def projection_state(spark, d):
    return shown(entries(spark, d))


@query("projection_after_clear", "pc", """, cut AS (SELECT projection, max(seq) AS c FROM pc WHERE key = 'cust:7' GROUP BY 1), r AS (SELECT pc.*, row_number() OVER (PARTITION BY pc.projection, key ORDER BY seq DESC) AS n FROM pc LEFT JOIN cut USING (projection) WHERE (c IS NULL OR seq > c) AND key <> 'cust:7')
    SELECT projection, lower(hex(key)) AS key, value FROM r WHERE n = 1 AND op = 'put'""")
def projection_after_clear(spark, d):
    """Each change of customer 7 read as a clearing of its projection."""
    cleared = F.col("key") == F.lit(b"cust:7")
    rows = views.changes(spark, d).withColumn("op", F.when(cleared, "clear").otherwise(F.col("op")))
    return shown(projections.state_after_clear(rows))


@query("patch_duplicate_keys", "", """SELECT patch, segment, key, count(*) AS times FROM (SELECT o_custkey % 50 AS patch, o_orderpriority AS key, o_orderstatus = 'P' AS c,
    sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS segment FROM orders) WHERE NOT c GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def patch_duplicate_keys(spark, d):
    raw = views.table(spark, d, "orders")
    rows = raw.select((F.col("o_custkey") % 50).alias("patch"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") == "P", "clear").otherwise("put").alias("op"), F.col("o_orderpriority").alias("key"))
    return projections.patch_duplicate_keys(rows)


@query("projection_get", "pe", "SELECT projection, lower(hex(key)) AS key, value FROM pe WHERE projection = '3-MEDIUM' AND key = 'cust:400'")
def projection_get(spark, d):
    return shown(projections.get(entries(spark, d), "3-MEDIUM", b"cust:400"))


@query("projection_scan_prefix", "pe", "SELECT projection, lower(hex(key)) AS key, value FROM pe WHERE projection = '2-HIGH' AND starts_with(key, 'cust:1') ORDER BY pe.key LIMIT 50")
def projection_scan_prefix(spark, d):
    return shown(projections.scan_prefix(entries(spark, d), "2-HIGH", b"cust:1", 50))


@query("projection_scan_prefix_page", "pe", "SELECT projection, lower(hex(key)) AS key, value FROM pe WHERE projection = '2-HIGH' AND starts_with(key, 'cust:1') AND key > 'cust:110' ORDER BY pe.key LIMIT 50")
def projection_scan_prefix_page(spark, d):
    return shown(projections.scan_prefix(entries(spark, d), "2-HIGH", b"cust:1", 50, b"cust:110"))


@query("projection_scan_range", "pe", "SELECT projection, lower(hex(key)) AS key, value FROM pe WHERE projection = '1-URGENT' AND key >= 'cust:2' AND key < 'cust:4' ORDER BY pe.key")
def projection_scan_range(spark, d):
    return shown(projections.scan_range(entries(spark, d), "1-URGENT", b"cust:2", b"cust:4", None, None))


@query("projections_list", "pv", "SELECT projection, version FROM pv")
def projections_list(spark, d):
    return projections.projections_list(versions(spark, d))


def versions(spark, d):
    """Each change is a patch of its own here."""
    return views.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("projection")).agg(F.count("*").alias("version"))


@query("projection_version", "pv", "SELECT coalesce(max(version), 0) AS version FROM pv WHERE projection = '2-HIGH'")
def projection_version(spark, d):
    return projections.projection_version(versions(spark, d), "2-HIGH")


@query("projection_entry_count", "pe", "SELECT count(*) AS entries FROM pe WHERE projection = '2-HIGH'")
def projection_entry_count(spark, d):
    return projections.entry_count(entries(spark, d), "2-HIGH")


@query("job_get", "jb", f"SELECT {', '.join(JOB[1:])} FROM jb WHERE job_id = 99")
def job_get(spark, d):
    return jobs.job(views.jobs(spark, d, ordered=False), 99).select(*JOB[1:])


@query("jobs_list", "jb", f"SELECT {', '.join(JOB)} FROM jb WHERE queue = '2-HIGH' AND state = 3 ORDER BY enqueue_sequence LIMIT 100")
def jobs_list(spark, d):
    return jobs.jobs_list(views.jobs(spark, d), "2-HIGH", 3, 100).select(*JOB)


@query("jobs_page", "jb", f"SELECT {', '.join(JOB)} FROM jb WHERE state = 0 AND enqueue_sequence > 700 ORDER BY enqueue_sequence LIMIT 64")
def jobs_page(spark, d):
    return jobs.jobs_list(views.jobs(spark, d), None, 0, 64, 700).select(*JOB)


@query("jobs_uncertain", "jb", f"SELECT {', '.join(JOB)} FROM jb WHERE state = 3")
def jobs_uncertain(spark, d):
    return jobs.jobs_list(views.jobs(spark, d), None, 3, None).select(*JOB)


@query("partition_heads", "jb", "SELECT queue, partition_key, job_id, state FROM (SELECT *, row_number() OVER (PARTITION BY queue, partition_key ORDER BY enqueue_sequence) AS r FROM jb WHERE state < 4) WHERE r = 1")
def partition_heads(spark, d):
    return jobs.heads(views.jobs(spark, d, ordered=False), ["o_orderdate", "job_id"]).select("queue", "partition_key", "job_id", "state")


@query("active_partitions", "jb", "SELECT queue, partition_key, min(enqueue_sequence) AS first_active_sequence FROM jb WHERE state < 4 GROUP BY 1, 2")
def active_partitions(spark, d):
    return jobs.active_partitions(views.jobs(spark, d))


@query("claim_plan", "jb", f""", heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY queue, partition_key ORDER BY enqueue_sequence) AS r FROM jb WHERE state < 4) WHERE r = 1),
    ready AS (SELECT heads.*, c.cur FROM heads LEFT JOIN (VALUES {', '.join(f"('{q}', '{c}')" for q, c in CURSORS.items())}) c(q, cur) ON q = queue WHERE not_before_ms <= {NOW} AND (state = 0 OR state = 2 AND retry_after_ms <= {NOW})),
    turns AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY CASE WHEN cur IS NULL OR partition_key > cur THEN 0 ELSE 1 END, partition_key) AS turn FROM ready)
    SELECT queue, turn, partition_key, job_id, attempt + 1 AS attempt FROM turns WHERE turn <= 100""")
def claim_plan(spark, d):
    """The next 100 leases of every queue."""
    rows = views.jobs(spark, d, ordered=False)
    return jobs.claim_plan(rows, CURSORS, NOW, 100, ["o_orderdate", "job_id"]).select("queue", "turn", "partition_key", "job_id", "attempt")


@query("claim_maintenance", "jb", f"""SELECT job_id, lease_expires_at_ms, CASE WHEN effect_mode = 0 THEN 3 WHEN attempt >= max_attempts THEN 5 ELSE 0 END AS to_state FROM jb
    WHERE queue = '2-HIGH' AND state = 1 AND lease_expires_at_ms < {NOW} ORDER BY lease_expires_at_ms, job_id LIMIT 64""")
def claim_maintenance(spark, d):
    return jobs.claim_maintenance(views.jobs(spark, d, ordered=False), "2-HIGH", NOW, "job_id").select("job_id", "lease_expires_at_ms", "to_state")


@query("ack_outcome", "jt", """SELECT a AS job_id, CASE WHEN job_id IS NULL THEN 'not_found' WHEN state NOT IN (1, 3) THEN 'transition' WHEN coalesce(lease_token <> t, true) THEN 'stale_token' END AS error,
    CASE WHEN state IN (1, 3) AND lease_token = t THEN 4 END AS to_state FROM (SELECT o_orderkey + 500 AS a, (o_orderkey + 500) * 7 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS t FROM orders) LEFT JOIN jt ON job_id = a""")
def ack_outcome(spark, d):
    key = F.col("o_orderkey") + 500
    commands = views.table(spark, d, "orders").select(key.alias("job_id"), (key * 7 + F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2)).alias("token"))
    return jobs.ack_outcome(commands, leased(spark, d))


@query("fail_outcome", "jt", f"""SELECT a AS job_id, CASE WHEN job_id IS NULL THEN 'not_found' WHEN state <> 1 AND NOT (state = 3 AND attempt >= 3) THEN 'transition' WHEN coalesce(lease_token <> t, true) THEN 'stale_token' END AS error,
    CASE WHEN state = 1 AND lease_token = t THEN CASE WHEN attempt >= 3 THEN 5 ELSE 2 END END AS to_state, CASE WHEN state = 1 AND lease_token = t AND attempt < 3 THEN coalesce(ra, {NOW} + 30000) END AS retry_after_ms
    FROM (SELECT o_orderkey + 500 AS a, (o_orderkey + 500) * 7 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS t, CASE WHEN o_orderkey % 3 = 0 THEN 5000 + o_orderkey END AS ra FROM orders) LEFT JOIN jt ON job_id = a""")
def fail_outcome(spark, d):
    key = F.col("o_orderkey") + 500
    commands = views.table(spark, d, "orders").select(key.alias("job_id"), (key * 7 + F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2)).alias("token"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 5000).alias("retry_after"))
    return jobs.fail_outcome(commands, leased(spark, d), NOW)


@query("cancel_outcome", "jt", """SELECT a AS job_id, CASE WHEN job_id IS NULL THEN 'not_found' WHEN state NOT IN (0, 1) THEN 'transition' WHEN lease_token IS DISTINCT FROM t THEN 'stale_token' END AS error,
    CASE WHEN state IN (0, 1) AND lease_token IS NOT DISTINCT FROM t THEN 6 END AS to_state FROM (SELECT o_orderkey + 500 AS a, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey + 500) * 7 + 1 END AS t FROM orders) LEFT JOIN jt ON job_id = a""")
def cancel_outcome(spark, d):
    key = F.col("o_orderkey") + 500
    commands = views.table(spark, d, "orders").select(key.alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, key * 7 + 1).alias("token"))
    return jobs.cancel_outcome(commands, leased(spark, d))


@query("resolve_outcome", "jb", """SELECT a AS job_id, CASE WHEN job_id IS NULL THEN 'not_found' WHEN state NOT IN (1, 3) THEN 'transition' END AS error,
    CASE WHEN state IN (1, 3) THEN CASE WHEN r = 'retry' THEN CASE WHEN attempt >= 3 THEN 5 ELSE 0 END WHEN r = 'succeeded' THEN 4 ELSE 5 END END AS to_state
    FROM (SELECT o_orderkey + 500 AS a, CASE (o_orderkey // 7) % 3 WHEN 0 THEN 'retry' WHEN 1 THEN 'succeeded' ELSE 'dead' END AS r FROM orders) LEFT JOIN jb ON job_id = a""")
def resolve_outcome(spark, d):
    kind = F.expr("element_at(array('retry', 'succeeded', 'dead'), cast((o_orderkey div 7) % 3 as int) + 1)")
    commands = views.table(spark, d, "orders").select((F.col("o_orderkey") + 500).alias("job_id"), kind.alias("resolution"))
    return jobs.resolve_outcome(commands, leased(spark, d))


@query("lease_extension_outcome", "jt", f"""SELECT a AS job_id, CASE WHEN job_id IS NULL THEN 'not_found' WHEN state <> 1 THEN 'not_leased' WHEN lease_token <> t THEN 'invalid_token' WHEN {NOW} > lease_expires_at_ms THEN 'expired' WHEN e <= lease_expires_at_ms THEN 'expiry_not_later' ELSE 'extended' END AS outcome
    FROM (SELECT o_orderkey + 500 AS a, (o_orderkey + 500) * 7 + CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS t, epoch_us(o_orderdate) // 1000 + 30000000 AS e FROM orders) LEFT JOIN jt ON job_id = a""")
def lease_extension_outcome(spark, d):
    key = F.col("o_orderkey") + 500
    commands = views.table(spark, d, "orders").select(key.alias("job_id"), (key * 7 + F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1)).alias("token"), (views.epoch_ms("o_orderdate") + 30_000_000).alias("new_expiry"))
    return jobs.extension_outcome(commands, leased(spark, d), NOW)


@query("illegal_transitions", "", """, legal(a, b) AS (VALUES (0,1),(0,6),(1,4),(1,2),(1,5),(1,6),(1,3),(1,0),(1,1),(2,1),(3,0),(3,4),(3,5)) SELECT o_orderkey AS job_id, (o_orderkey % 7)::INT AS from_state, (o_custkey % 7)::INT AS to_state FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM legal WHERE a = o_orderkey % 7 AND b = o_custkey % 7)""")
def illegal_transitions(spark, d):
    moves = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 7).cast("int").alias("from_state"), (F.col("o_custkey") % 7).cast("int").alias("to_state"))
    return jobs.illegal_transitions(moves)


@query("recover_claim", "jb rc", f"SELECT rc.transaction_id, rc.job_id, coalesce(state = 1 AND rc.lease_token = job_id % 100 AND lease_expires_at_ms >= {NOW}, false) AS executable FROM rc JOIN jb USING (job_id)")
def recover_claim(spark, d):
    held = views.jobs(spark, d, ordered=False).withColumn("lease_token", F.col("job_id") % 100)
    return recovery.recover_claim(views.receipts(spark, d), held, NOW)


@query("recover_transaction", "tx", "SELECT a AS transaction_sequence, CASE WHEN operation_count IS NULL THEN 'absent' ELSE 'committed' END AS outcome, committed_at_ms, operation_count FROM (SELECT event_id AS a FROM events) LEFT JOIN tx ON transaction_sequence = a")
def recover_transaction(spark, d):
    asked = views.event_rows(spark, d).select(F.col("event_id").alias("transaction_sequence"))
    return recovery.recover_transactions(asked, views.transactions(spark, d))


def broken_streams(spark, d):
    """Streams of which some are missing and some are at a wrong version."""
    user = F.substring("stream_id", 6, 20).cast("long")
    return views.streams(spark, d).where(user % 10 != 0).withColumn("current_version", F.col("current_version") + F.when(user % 7 == 0, 1).otherwise(0))


BROKEN = ", bs AS (SELECT stream_id, current_version + CASE WHEN substr(stream_id, 6)::BIGINT % 7 = 0 THEN 1 ELSE 0 END AS current_version FROM st WHERE substr(stream_id, 6)::BIGINT % 10 <> 0)"
WRONG = "SELECT 'stream_versions' AS check, bs.stream_id || ' is at ' || bs.current_version || ', its events at ' || st.current_version AS detail FROM bs JOIN st USING (stream_id) WHERE bs.current_version <> st.current_version"
ORPHAN = "SELECT 'stream_versions' AS check, 'no stream ' || stream_id AS detail FROM st WHERE stream_id NOT IN (SELECT stream_id FROM bs)"
RECEIPT = "SELECT 'claim_receipts' AS check, 'receipt of transaction ' || transaction_id || ': missing job ' || job_id AS detail FROM rc WHERE job_id NOT IN (SELECT job_id FROM jb WHERE job_id % 10 <> 0)"


@query("verify_stream_versions", "st", f"{BROKEN} {WRONG}")
def verify_stream_versions(spark, d):
    return verify.stream_versions(broken_streams(spark, d), views.versioned(spark, d))


@query("verify_orphan_streams", "st", f"{BROKEN} {ORPHAN}")
def verify_orphan_streams(spark, d):
    return verify.orphan_streams(broken_streams(spark, d), views.event_rows(spark, d))


@query("verify_terminal_jobs", "jb", "SELECT 'terminal_jobs' AS check, 'job ' || job_id || ' has ended with a lease' AS detail FROM jb WHERE state >= 4 AND job_id % 11 = 0")
def verify_terminal_jobs(spark, d):
    return verify.terminal_jobs(leased(spark, d).withColumn("worker_id", F.when(F.col("job_id") % 11 == 0, "w0").otherwise(F.col("worker_id"))))


@query("verify_leased_jobs", "jb", "SELECT 'leased_jobs' AS check, 'job ' || job_id || ' lacks part of its lease' AS detail FROM jb WHERE state = 1 AND job_id % 5 = 0")
def verify_leased_jobs(spark, d):
    return verify.leased_jobs(leased(spark, d).withColumn("worker_id", F.when(F.col("job_id") % 5 != 0, F.col("worker_id"))))


@query("verify_active_partitions", "jb", "SELECT 'active_partitions' AS check, queue || '/' || partition_key || ' has no active job' AS detail FROM (SELECT DISTINCT queue, partition_key FROM jb) p WHERE NOT EXISTS (SELECT 1 FROM jb WHERE state < 4 AND jb.queue = p.queue AND jb.partition_key = p.partition_key)")
def verify_active_partitions(spark, d):
    rows = views.jobs(spark, d, ordered=False)
    return verify.active_partitions(rows.select("queue", "partition_key").distinct(), rows)


@query("verify_receipt_jobs", "jb rc", RECEIPT)
def verify_receipt_jobs(spark, d):
    return verify.receipt_jobs(views.receipts(spark, d), views.jobs(spark, d, ordered=False).where("job_id % 10 <> 0"))


@query("verify_receipt_transactions", "rc tx", "SELECT 'claim_receipts' AS check, 'receipt of job ' || job_id || ': missing transaction ' || transaction_id AS detail FROM rc WHERE transaction_id NOT IN (SELECT transaction_sequence FROM tx WHERE transaction_sequence % 2 = 1)")
def verify_receipt_transactions(spark, d):
    known = views.transactions(spark, d).where("transaction_sequence % 2 = 1").select(F.col("transaction_sequence").alias("transaction_id"))
    return verify.receipt_transactions(views.receipts(spark, d), known)


@query("verify_foreign_keys", "ev", "SELECT 'foreign_key_check' AS check, 'events.transaction_sequence ' || t AS detail FROM (SELECT DISTINCT transaction_sequence AS t FROM ev) WHERE t % 9 = 0 UNION ALL SELECT 'foreign_key_check', 'receipts.job_id ' || k FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)")
def verify_foreign_keys(spark, d):
    rows = views.sequenced(spark, d)
    known = rows.select("transaction_sequence").distinct().where("transaction_sequence % 9 <> 0")
    first = verify.foreign_key(rows, "transaction_sequence", known, "events")
    return verify.report(first, verify.foreign_key(views.receipts(spark, d), "job_id", views.jobs(spark, d, ordered=False).where("job_id % 10 <> 0"), "receipts"))


LEASED = "SELECT 'leased_jobs' AS check, 'job ' || job_id || ' lacks part of its lease' AS detail FROM jb WHERE state = 1 AND job_id % 5 = 0"
CHECKS = ("verify_terminal_jobs", "verify_active_partitions", "verify_receipt_transactions", "verify_foreign_keys")


@query("verify_report", "ev st tx jb rc", " UNION ALL ".join([f"{BROKEN} {WRONG}", ORPHAN, RECEIPT, LEASED, *(f"SELECT * FROM ({SQL[c]})" for c in CHECKS)]))
def verify_report(spark, d):
    """All eight checks."""
    return verify.report(verify_stream_versions(spark, d), verify_orphan_streams(spark, d), verify_receipt_jobs(spark, d), verify_leased_jobs(spark, d), *(QUERIES[c](spark, d) for c in CHECKS))


@query("stats_counts", "ev tx st jb pv pe", "SELECT 'transactions' AS name, count(*) AS rows FROM tx UNION ALL SELECT 'events', count(*) FROM ev UNION ALL SELECT 'streams', count(*) FROM st UNION ALL SELECT 'projections', count(*) FROM pv UNION ALL SELECT 'entries', count(*) FROM pe UNION ALL SELECT 'active_partitions', count(*) FROM (SELECT DISTINCT queue, partition_key FROM jb WHERE state < 4)")
def stats_counts(spark, d):
    rows = views.jobs(spark, d, ordered=False).withColumn("enqueue_sequence", F.col("job_id"))
    return stats.counts(transactions=views.transactions(spark, d), events=views.event_rows(spark, d), streams=views.streams(spark, d), projections=versions(spark, d), entries=entries(spark, d), active_partitions=jobs.active_partitions(rows))


@query("stats_jobs_by_state", "jb", "SELECT CASE state WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' WHEN 2 THEN 'retry_wait' WHEN 3 THEN 'uncertain' WHEN 4 THEN 'succeeded' WHEN 5 THEN 'dead' ELSE 'cancelled' END AS state, count(*) AS jobs FROM jb GROUP BY 1")
def stats_jobs_by_state(spark, d):
    return stats.jobs_by_state(views.jobs(spark, d, ordered=False))


@query("stats_oldest_lease", "jb", "SELECT min(lease_expires_at_ms) AS oldest_active_lease_ms FROM jb WHERE state = 1")
def stats_oldest_lease(spark, d):
    return stats.oldest_active_lease(views.jobs(spark, d, ordered=False))


@query("stats_oldest_uncertain", "jb tx", "SELECT min(committed_at_ms) AS oldest_uncertain_job_ms FROM jb JOIN tx ON transaction_sequence = job_id WHERE state = 3")
def stats_oldest_uncertain(spark, d):
    rows = views.jobs(spark, d, ordered=False).withColumn("transaction_sequence", F.col("job_id"))
    return stats.oldest_uncertain_job(rows, views.transactions(spark, d), "transaction_sequence")


@query("export_events", "ev", "SELECT 'event' AS kind, global_sequence, event_id, stream_id, event_type, occurred_at_ms, transaction_sequence, octet_length(encode(payload))::BIGINT AS payload_len FROM ev")
def export_events(spark, d):
    return export.redacted(views.sequenced(spark, d).select(*EVENT), "event", ["payload"])


@query("export_events_with_payloads", "ev", "SELECT 'event' AS kind, event_id, stream_id, octet_length(encode(payload))::BIGINT AS payload_len, lower(hex(payload)) AS payload_hex FROM ev")
def export_events_with_payloads(spark, d):
    return export.redacted(views.event_rows(spark, d).select("event_id", "stream_id", "payload"), "event", ["payload"], include=True)


@query("export_jobs", "jb", f"SELECT 'job' AS kind, {', '.join(JOB)} FROM jb")
def export_jobs(spark, d):
    return export.redacted(views.jobs(spark, d).select(*JOB), "job", [])


@query("limit_violations", "", "SELECT event_id, octet_length(encode(props))::BIGINT AS size FROM events WHERE octet_length(encode(props)) > 8")
def limit_violations(spark, d):
    return views.event_rows(spark, d).select("event_id", F.octet_length("payload").cast("long").alias("size")).where("size > 8")


@query("projection_after_replace", "pc", """, cut AS (SELECT projection, max(seq) AS c FROM pc WHERE key = 'cust:7' GROUP BY 1), r AS (SELECT pc.*, c, row_number() OVER (PARTITION BY pc.projection, key ORDER BY seq DESC) AS n FROM pc LEFT JOIN cut USING (projection) WHERE c IS NULL OR seq >= c)
    SELECT projection, lower(hex(key)) AS key, value FROM r WHERE n = 1 AND (op = 'put' OR key = 'cust:7')""")
def projection_after_replace(spark, d):
    """Each change of customer 7 read as a replacement of its projection by that one entry."""
    replaced = F.col("key") == F.lit(b"cust:7")
    rows = views.changes(spark, d).withColumns({"op": F.when(replaced, "replace").otherwise(F.col("op")), "entries": F.when(replaced, F.array(F.struct("key", "value")))})
    return shown(projections.state_after_clear(projections.expand_replace(rows)))


@query("upsert_streams", "st", "SELECT stream_id, max(current_version) AS current_version FROM (SELECT * FROM st UNION ALL SELECT 'user:' || user_id, event_id % 300 FROM events UNION ALL SELECT 'expected', 0) GROUP BY 1")
def upsert_streams(spark, d):
    rows = views.event_rows(spark, d).select("stream_id", (F.col("event_id") % 300).alias("current_version"))
    expected = spark.range(1).select(F.lit("expected").alias("stream_id"), F.lit(0).cast("long").alias("current_version"))
    return events.upsert_streams(views.streams(spark, d), rows.unionByName(expected))


@query("request_digests", "", """SELECT event_id AS transaction_id, sha256(unhex(printf('%016x', epoch_us(ts) // 1000)) || '\\x00'::BLOB || unhex(printf('%016x', octet_length(encode(props)))) || encode(props) || unhex(printf('%016x', 1))
    || unhex(printf('%016x', octet_length(encode('user:' || user_id)))) || encode('user:' || user_id) || unhex(printf('%016x', event_id % 100)) || unhex(printf('%016x', 0))) AS request_digest FROM events""")
def request_digests(spark, d):
    rows = views.event_rows(spark, d)
    return events.expectation_digest(rows.select(F.col("event_id").alias("transaction_id"), F.col("occurred_at_ms").alias("committed_at_ms"), F.col("payload").alias("metadata"), "stream_id", (F.col("event_id") % 100).alias("expected")))


@query("enqueue_jobs", "jb", """SELECT (SELECT max(enqueue_sequence) FROM jb) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS enqueue_sequence, o_orderkey + 700 AS job_id, o_orderpriority AS queue, 0 AS state, 0 AS attempt, 0 AS not_before_ms, 3 AS max_attempts
    FROM orders WHERE o_orderkey + 700 NOT IN (SELECT job_id FROM jb)""")
def enqueue_jobs(spark, d):
    specs = views.table(spark, d, "orders").select((F.col("o_orderkey") + 700).alias("job_id"), F.col("o_orderpriority").alias("queue"), "o_orderdate")
    return jobs.enqueue(specs, views.jobs(spark, d), "o_orderdate", "job_id").drop("o_orderdate")


@query("duplicate_jobs", "jb", "SELECT o_orderkey + 700 AS job_id FROM orders WHERE o_orderkey + 700 IN (SELECT job_id FROM jb)")
def duplicate_jobs(spark, d):
    return jobs.duplicate_jobs(views.table(spark, d, "orders").select((F.col("o_orderkey") + 700).alias("job_id")), views.jobs(spark, d, ordered=False))


@query("jobs_ended", "jb", f"SELECT job_id, 6 AS state, {NOW} AS terminal_at_ms, NULL::VARCHAR AS worker_id, NULL::BIGINT AS lease_expires_at_ms, NULL::BIGINT AS retry_after_ms, attempt FROM jb WHERE state < 2")
def jobs_ended(spark, d):
    return jobs.ended(views.jobs(spark, d, ordered=False).where("state < 2"), NOW).select("job_id", "state", "terminal_at_ms", "worker_id", "lease_expires_at_ms", "retry_after_ms", "attempt")


@query("export_transactions", "tx", "SELECT 'transaction' AS kind, * FROM tx")
def export_transactions(spark, d):
    return export.redacted(views.transactions(spark, d), "transaction", [])


@query("export_streams", "st", "SELECT 'stream' AS kind, * FROM st")
def export_streams(spark, d):
    return export.redacted(views.streams(spark, d), "stream", [])


@query("export_projection_entries", "pe", "SELECT 'projection_entry' AS kind, projection, lower(hex(key)) AS key_hex, octet_length(encode(value::VARCHAR)) > 0 AS has_value FROM pe")
def export_projection_entries(spark, d):
    rows = entries(spark, d).select("projection", hexed("key").alias("key_hex"), F.col("value").isNotNull().alias("has_value"))
    return export.redacted(rows, "projection_entry", [])


@query("export_active_partitions", "jb", "SELECT 'active_partition' AS kind, queue, partition_key, min(enqueue_sequence) AS first_active_sequence FROM jb WHERE state < 4 GROUP BY 2, 3")
def export_active_partitions(spark, d):
    return export.redacted(jobs.active_partitions(views.jobs(spark, d)), "active_partition", [])


@query("export_claim_receipts", "rc", "SELECT 'claim_receipt' AS kind, transaction_id, job_id, attempt FROM rc")
def export_claim_receipts(spark, d):
    return export.redacted(views.receipts(spark, d).drop("lease_token"), "claim_receipt", [])
