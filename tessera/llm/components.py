"""Connected components of links by randomised contraction, all in DataFrames.

Each round hooks every node to the neighbour (or itself) that comes first in that round's hash order and
merges them; an expected constant share of the nodes goes each round, whatever the shape, so long chains
need no more than a logarithmic number of rounds. Nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def contract(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); nodes of a component share a root. Self-links are allowed."""
    links = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = materialize(nodes.select("node", F.col("node").alias("root")), "roots")
    turn = 0
    while not links.isEmpty():
        turn += 1
        both = links.union(links.select("b", "a"))
        ranked = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        hooks = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select("a", F.least(F.col("m"), ranked("a"))["id"].alias("to"))
        hooks = materialize(hooks, "hooks")
        to_a, to_b = hooks.select("a", F.col("to").alias("ra")), hooks.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        links = links.join(to_a, "a").join(to_b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        links = materialize(links.where("a <> b").distinct(), "links")
        roots = materialize(roots.join(hooks.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
    return roots


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, label) after the labels of linked documents have become one; a label is the smallest doc_id that has it."""
    to = contract(links.join(labels.select(F.col("doc_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("doc_id").alias("b"), F.col("label").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    smallest = to.join(to.groupBy("root").agg(F.min("node").alias("least")), "root").select(F.col("node").alias("label"), "least")
    return materialize(labels.join(smallest, "label", "left").select("doc_id", F.coalesce("least", "label").alias("label")), "labels")
