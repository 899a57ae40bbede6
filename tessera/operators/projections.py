"""Projections as change logs: the state is the last change of each key after the last clearing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.columns import between_keys, limited, prefix_end


def state(changes: DataFrame) -> DataFrame:
    """projection, key, value that the puts and deletes (seq, op) leave; one aggregation, combined before its shuffle."""
    last = changes.groupBy("projection", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.where("last.op = 'put'").select("projection", "key", "last.value")


def state_after_clear(changes: DataFrame) -> DataFrame:
    """The state where an op `clear` (key null) drops all that came before it in its projection."""
    cleared = changes.where("op = 'clear'").groupBy("projection").agg(F.max("seq").alias("cleared"))
    after = changes.where("op <> 'clear'").join(cleared, "projection", "left").where("cleared is null or seq > cleared")
    return state(after.drop("cleared"))


def expand_replace(changes: DataFrame) -> DataFrame:
    """Each op `replace` (its entries: an array of key and value) as a clear and the puts after it; seq becomes (seq, place)."""
    clear = F.array(F.struct(F.lit("clear").alias("op"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast(changes.schema["value"].dataType).alias("value")))
    puts = F.transform("entries", lambda e: F.struct(F.lit("put").alias("op"), e["key"].alias("key"), e["value"].alias("value")))
    steps = F.when(F.col("op") == "replace", F.concat(clear, puts)).otherwise(F.array(F.struct("op", "key", "value")))
    rows = changes.select("projection", "seq", F.posexplode(steps).alias("place", "step"))
    return rows.select("projection", F.struct("seq", "place").alias("seq"), "step.*")


def patch_duplicate_keys(mutations: DataFrame) -> DataFrame:
    """Keys that a patch (patch, idx, op, key) touches twice without a clearing in between; replace rows carry their keys as puts after a clear."""
    segment = F.sum(F.when(F.col("op") == "clear", 1).otherwise(0)).over(W.partitionBy("patch").orderBy("idx"))
    cut = mutations.withColumn("segment", segment.cast("long")).where("op <> 'clear'")
    return cut.groupBy("patch", "segment", "key").agg(F.count("*").alias("times")).where("times > 1")


def get(entries: DataFrame, projection: str, key: bytes) -> DataFrame:
    return entries.where((F.col("projection") == projection) & (F.col("key") == F.lit(key)))


def scan_range(entries: DataFrame, projection: str, start: bytes | None, end: bytes | None, after: bytes | None, limit: int | None) -> DataFrame:
    """Entries with start <= key < end and key > after, in key order."""
    return limited(entries.where((F.col("projection") == projection) & between_keys(start, end, after)).orderBy("key"), limit)


def scan_prefix(entries: DataFrame, projection: str, prefix: bytes, limit: int | None, after: bytes | None = None) -> DataFrame:
    return scan_range(entries, projection, prefix, prefix_end(prefix), after, limit)


def projections_list(versions: DataFrame) -> DataFrame:
    return versions.orderBy("projection")


def projection_version(versions: DataFrame, projection: str) -> DataFrame:
    return versions.where(F.col("projection") == projection).agg(F.coalesce(F.max("version"), F.lit(0).cast("long")).alias("version"))


def entry_count(entries: DataFrame, projection: str) -> DataFrame:
    return entries.where(F.col("projection") == projection).agg(F.count("*").alias("entries"))
