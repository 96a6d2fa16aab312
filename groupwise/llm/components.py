"""Connected components of a link table, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupwise.llm.common import stored


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b): component is the smallest node it reaches.

    Each round links a node's larger neighbours, then its smaller ones, to the least of them (large star and small
    star), so chains halve; every round is written to the shared folder. A node is never gathered with its
    neighbours: only their minimum is, by partial aggregation. Links with a null end are left out.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = stored(edges, "links")  # a < b: b hangs on a
    before = None
    while before != (now := _state(edges)):
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("node", "other")
        least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
        large = both.where("other > node").join(least, "node").select(F.col("least").alias("a"), F.col("other").alias("b"))
        large = large.distinct()
        small_least = large.groupBy("b").agg(F.min("a").alias("least"))
        joined = large.join(small_least, "b")
        small = joined.select(F.col("least").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("least").alias("a"), "b"))
        edges = stored(small.where("a <> b").distinct(), "links")
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
