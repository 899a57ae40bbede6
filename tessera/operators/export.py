"""Diagnostic export: rows of a store as JSON lines, without payloads unless asked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import hexed


def redacted(rows: DataFrame, kind: str, secret: list[str], include: bool = False) -> DataFrame:
    """rows with each secret column as its length in bytes (and, if asked, in hex), and its kind."""
    for name in secret:
        rows = rows.withColumn(f"{name}_len", F.octet_length(name).cast("long"))
        rows = rows.withColumn(f"{name}_hex", hexed(F.col(name).cast("binary"))).drop(name) if include else rows.drop(name)
    return rows.withColumn("kind", F.lit(kind))


def lines(*kinds: tuple[DataFrame, list[str]]) -> DataFrame:
    """One text column `value` of JSON lines: kinds in their order, rows of each by its order columns (numbers by value, text and bytes byte by byte).

    Order columns that are bytes are left out of the lines.
    """
    made = []
    for rank, (rows, order) in enumerate(kinds):
        types = dict(rows.dtypes)
        names = [c for c in rows.columns if c != "kind" and types[c] != "binary"]
        json = F.to_json(F.struct("kind", *names), {"ignoreNullFields": "false"})
        number = [F.col(c).cast("long") if types[c] in ("bigint", "int") else F.lit(None).cast("long") for c in order]
        data = [F.lit(None).cast("binary") if types[c] in ("bigint", "int") else F.col(c).cast("binary") for c in order]
        keys = [F.struct(n, b) for n, b in zip(number, data)] + [F.struct(F.lit(None).cast("long"), F.lit(None).cast("binary"))] * (2 - len(order))
        made.append(rows.select(F.lit(rank).alias("rank"), *(k.cast("struct<n: bigint, b: binary>").alias(f"ord{i}") for i, k in enumerate(keys)), json.alias("value")))
    return reduce(DataFrame.unionByName, made).orderBy("rank", "ord0", "ord1").select("value")
