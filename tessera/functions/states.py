"""Job states and the transitions between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States by code, in order, and the legal transitions.
STATES = ("pending", "leased", "retry_wait", "uncertain", "succeeded", "dead", "cancelled")
PENDING, LEASED, RETRY_WAIT, UNCERTAIN, SUCCEEDED, DEAD, CANCELLED = range(7)
TRANSITIONS = {
    PENDING: (LEASED, CANCELLED),
    LEASED: (SUCCEEDED, RETRY_WAIT, DEAD, CANCELLED, UNCERTAIN, PENDING, LEASED),
    RETRY_WAIT: (LEASED,),
    UNCERTAIN: (PENDING, SUCCEEDED, DEAD),
    SUCCEEDED: (),
    DEAD: (),
    CANCELLED: (),
}
ACTIVE = (PENDING, LEASED, RETRY_WAIT, UNCERTAIN)
TERMINAL = (SUCCEEDED, DEAD, CANCELLED)
RECONCILABLE, IDEMPOTENT = 0, 1


def allowed(state: int, to: int) -> bool:
    return to in TRANSITIONS[state]


def state_name(state: str | Column) -> Column:
    """The name of a state code; `unknown(n)` for others."""
    code = F.col(state) if isinstance(state, str) else state
    return F.coalesce(*(F.when(code == k, n) for k, n in enumerate(STATES)), F.concat(F.lit("unknown("), code.cast("string"), F.lit(")")))


def transition_table(spark: SparkSession) -> DataFrame:
    """The legal transitions as rows; thirteen of them."""
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_state int, to_state int")
