"""Column helpers: epoch milliseconds, row limits, byte prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits from here on mean no limit, as None does.
NO_LIMIT = 1 << 63


def epoch_ms(name: str) -> Column:
    """Whole milliseconds since the epoch, cut, not rounded."""
    return F.expr(f"unix_micros(cast({name} as timestamp)) div 1000")


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """At most limit rows; None, or what no 64-bit number holds, is all of them."""
    return rows if limit is None or limit >= NO_LIMIT else rows.limit(limit)


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all that start with prefix; None if there is none."""
    bare = prefix.rstrip(b"\xff")
    return bare[:-1] + bytes([bare[-1] + 1]) if bare else None


def hexed(column: str | Column) -> Column:
    return F.lower(F.hex(column))


def between_keys(start: bytes | None = None, end: bytes | None = None, after: bytes | None = None, column: str = "key") -> Column:
    """start <= key < end and key > after; bounds that are None are left out, so that the rest reach the Parquet scan."""
    key = F.col(column)
    bounds = [b for b, given in ((lambda v: key >= F.lit(v), start), (lambda v: key < F.lit(v), end), (lambda v: key > F.lit(v), after)) if given is not None]
    given = [v for v in (start, end, after) if v is not None]
    out = F.lit(True)
    for test, value in zip(bounds, given):
        out = out & test(value)
    return out
