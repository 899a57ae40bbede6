"""Job queues: reads, claim planning, expiry, and what each command does to a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import states as S
from tessera.functions.columns import limited
from tessera.functions.numbering import global_sequence

#: Most expired leases repaired by one claim, and the default wait before a retry in ms.
MAINTENANCE, RETRY_MS = 64, 30_000


def job(jobs: DataFrame, job_id) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def jobs_list(jobs: DataFrame, queue: str | None, state: int | None, limit: int | None, after: int | None = None) -> DataFrame:
    """Jobs in enqueue order; filters that are None are left out of the plan."""
    for name, value in (("queue", queue), ("state", state)):
        if value is not None:
            jobs = jobs.where(F.col(name) == value)
    if after is not None:
        jobs = jobs.where(F.col("enqueue_sequence") > after)
    return limited(jobs.orderBy("enqueue_sequence"), limit)


def heads(jobs: DataFrame, order: list[str]) -> DataFrame:
    """The first active job of each queue's partition."""
    active = jobs.where(F.col("state").isin(*S.ACTIVE))
    place = F.row_number().over(W.partitionBy("queue", "partition_key").orderBy(*order))
    return active.withColumn("place", place).where("place = 1").drop("place")


def ready(now_ms: int) -> Column:
    """Whether a head may be leased now."""
    due = F.col("not_before_ms") <= now_ms
    return (F.col("state") == S.PENDING) & due | (F.col("state") == S.RETRY_WAIT) & due & (F.col("retry_after_ms") <= now_ms)


def claim_plan(jobs: DataFrame, cursors: dict[str, str] | str | None, now_ms: int, limit: int, order: list[str], queue: str | None = None) -> DataFrame:
    """The heads to lease next in each queue, `limit` at most, round robin from the partition after the cursor; turn is their order, attempt the new one."""
    if queue is not None:
        jobs = jobs.where(F.col("queue") == queue)
    if isinstance(cursors, dict):
        cursor = F.coalesce(*(F.when(F.col("queue") == q, c) for q, c in cursors.items()), F.lit(None).cast("string"))
    else:
        cursor = F.lit(cursors).cast("string")
    lap = F.when(cursor.isNull() | (F.col("partition_key") > cursor), 0).otherwise(1)
    leasable = heads(jobs, order).where(ready(now_ms)).withColumn("lap", lap)
    turn = F.row_number().over(W.partitionBy("queue").orderBy("lap", "partition_key")).cast("long")
    return leasable.withColumn("turn", turn).where(F.col("turn") <= limit).withColumn("attempt", F.col("attempt") + 1).drop("lap")


def claim_maintenance(jobs: DataFrame, queue: str, now_ms: int, tie: str, limit: int = MAINTENANCE) -> DataFrame:
    """The oldest expired leases of a queue and the state each goes to."""
    expired = jobs.where((F.col("queue") == queue) & (F.col("state") == S.LEASED) & (F.col("lease_expires_at_ms") < now_ms))
    to = F.when(F.col("effect_mode") == S.RECONCILABLE, S.UNCERTAIN).when(F.col("attempt") >= F.col("max_attempts"), S.DEAD).otherwise(S.PENDING)
    return limited(expired.orderBy("lease_expires_at_ms", tie), limit).withColumn("to_state", to)


def active_partitions(jobs: DataFrame) -> DataFrame:
    """queue, partition_key and first active sequence of the partitions with an active job."""
    return jobs.where(F.col("state").isin(*S.ACTIVE)).groupBy("queue", "partition_key").agg(F.min("enqueue_sequence").alias("first_active_sequence"))


def refused(to: int, token_ok: Column | None = None) -> Column:
    """The error of a command on the job row at hand, or null: unknown job, illegal transition, wrong token, in this order."""
    sources = [s for s in S.TRANSITIONS if S.allowed(s, to)]
    error = F.when(F.col("state").isNull(), "not_found").when(~F.col("state").isin(*sources), "transition")
    return error if token_ok is None else error.when(~F.coalesce(token_ok, F.lit(False)), "stale_token")


def fail_outcome(commands: DataFrame, jobs: DataFrame, now_ms: int) -> DataFrame:
    """job_id, error, to_state and retry_after_ms for fail commands (job_id, token, retry_after); jobs have lease_token."""
    both = commands.join(jobs, "job_id", "left")
    spent = F.col("attempt") >= F.col("max_attempts")
    same = F.col("token") == F.col("lease_token")
    error = F.when(spent, refused(S.DEAD, same)).otherwise(refused(S.RETRY_WAIT, same))
    retry = F.coalesce("retry_after", F.try_add(F.lit(now_ms), F.lit(RETRY_MS)))
    error = F.coalesce(error, F.when(~spent & retry.isNull(), "overflow"))
    to = F.when(error.isNull(), F.when(spent, S.DEAD).otherwise(S.RETRY_WAIT))
    return both.select("job_id", error.alias("error"), to.alias("to_state"), F.when(to == S.RETRY_WAIT, retry).alias("retry_after_ms"))


def ack_outcome(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, error and to_state for acknowledgements (job_id, token); expiry does not matter."""
    both = commands.join(jobs, "job_id", "left")
    error = refused(S.SUCCEEDED, F.col("token") == F.col("lease_token"))
    return both.select("job_id", error.alias("error"), F.when(error.isNull(), S.SUCCEEDED).alias("to_state"))


def cancel_outcome(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, error and to_state for cancellations (job_id, token or null): a pending job takes none, a leased one its own."""
    both = commands.join(jobs, "job_id", "left")
    error = refused(S.CANCELLED, F.col("token").eqNullSafe(F.col("lease_token")))
    return both.select("job_id", error.alias("error"), F.when(error.isNull(), S.CANCELLED).alias("to_state"))


def resolve_outcome(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, error and to_state for resolutions (job_id, resolution: retry, succeeded or dead); a retry without attempts left is dead."""
    both = commands.join(jobs, "job_id", "left")
    wanted = F.when(F.col("resolution") == "retry", F.when(F.col("attempt") >= F.col("max_attempts"), S.DEAD).otherwise(S.PENDING)).when(F.col("resolution") == "succeeded", S.SUCCEEDED).otherwise(S.DEAD)
    legal = F.col("state").isin(*[s for s in S.TRANSITIONS if S.allowed(s, S.DEAD)])  # the same states lead to all three
    error = F.when(F.col("state").isNull(), "not_found").when(~legal, "transition")
    return both.select("job_id", error.alias("error"), F.when(error.isNull(), wanted).alias("to_state"))


def extension_outcome(commands: DataFrame, jobs: DataFrame, now_ms: int) -> DataFrame:
    """job_id and outcome for lease extensions (job_id, token, new_expiry)."""
    both = commands.join(jobs, "job_id", "left")
    outcome = (
        F.when(F.col("state").isNull(), "not_found").when(F.col("state") != S.LEASED, "not_leased").when(~F.col("token").eqNullSafe(F.col("lease_token")), "invalid_token")
        .when(F.lit(now_ms) > F.col("lease_expires_at_ms"), "expired").when(F.col("new_expiry") <= F.col("lease_expires_at_ms"), "expiry_not_later").otherwise("extended")
    )
    return both.select("job_id", outcome.alias("outcome"))


def enqueue(specs: DataFrame, jobs: DataFrame, key: str, *ties: str) -> DataFrame:
    """New jobs (job_id, queue, partition_key, and order columns) as pending ones above the last enqueue_sequence; ids that exist are left out (duplicate_jobs tells them)."""
    base = jobs.agg(F.coalesce(F.max("enqueue_sequence"), F.lit(0).cast("long"))).collect()[0][0]
    rows = global_sequence(specs.join(jobs.select("job_id"), "job_id", "left_anti"), "enqueue_sequence", key, *ties)
    return rows.withColumns({"enqueue_sequence": F.col("enqueue_sequence") + base, "state": F.lit(S.PENDING), "attempt": F.lit(0), "not_before_ms": F.lit(0).cast("long"), "max_attempts": F.lit(3)})


def duplicate_jobs(specs: DataFrame, jobs: DataFrame) -> DataFrame:
    return specs.join(jobs, "job_id", "left_semi").select("job_id")


def ended(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Jobs as they are once cancelled at now_ms: lease and retry time gone, the end's time set."""
    none = {c: F.lit(None).cast(t) for c, t in (("worker_id", "string"), ("lease_expires_at_ms", "long"), ("retry_after_ms", "long"))}
    return jobs.withColumns(none | {"state": F.lit(S.CANCELLED).cast("long"), "terminal_at_ms": F.lit(now_ms).cast("long")})


def illegal_transitions(moves: DataFrame) -> DataFrame:
    """Moves (from_state, to_state) that no rule allows; the thirteen rules are broadcast."""
    return moves.join(F.broadcast(S.transition_table(moves.sparkSession)), ["from_state", "to_state"], "left_anti")
