"""A dense global order without bringing all rows to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def global_sequence(rows: DataFrame, name: str, key: str, *ties: str) -> DataFrame:
    """rows with `name`: 1, 2, ... in the order of key (a number or a time), then ties, over the whole table.

    Approximate quantiles of the key cut it into as many ranges as there are shuffle partitions; a key that spans
    several of these is cut in turn at quantiles of the first tie. Rows are numbered within their range and the
    counts of earlier ranges added. The driver sees the cuts and counts only, a few per shuffle partition.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = quantiles(rows, key, n)
    cuts = [F.col(key) >= F.lit(c) for c in sorted(set(found))]
    for value in sorted(c for c in set(found) if found.count(c) > 1) if ties else ():
        own = sorted(set(quantiles(rows.where(F.col(key) == F.lit(value)), ties[0], found.count(value))))
        cuts += [(F.col(key) > F.lit(value)) | (F.col(key) == F.lit(value)) & (F.col(ties[0]) >= F.lit(t)) for t in own]
    spot = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    counts = {r["spot"]: r["count"] for r in rows.groupBy(spot.alias("spot")).count().collect()}
    before = F.coalesce(*(F.when(F.col("range_spot") == s, sum(v for k, v in counts.items() if k < s)) for s in counts), F.lit(0))
    ordered = W.partitionBy("range_spot").orderBy(key, *ties)
    return rows.withColumn("range_spot", spot).withColumn(name, F.row_number().over(ordered).cast("long") + before.cast("long")).drop("range_spot")


def quantiles(rows: DataFrame, column: str, n: int) -> list:
    """Approximate cuts of a column into n ranges; a value that fills several is there several times."""
    if n < 2:
        return []
    return rows.agg(F.percentile_approx(column, F.array(*(F.lit(i / n) for i in range(1, n))), 1000).alias("c")).collect()[0]["c"] or []
