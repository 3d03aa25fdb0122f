"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvio.llm.common import write_table


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b`` (longs): the label is the least node of its component.

    Each step hangs every node on the least node it knows; no neighbourhood is
    collected (a star's centre costs one aggregate and one streamed join). The
    edges are written after each step, until all are stars on their least node.
    """
    now = write_table(_down(edges), "components")
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _down(large.union(least.where("m < a").select("a", F.col("m").alias("b"))))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = write_table(_down(small.union(low.select("a", F.col("m").alias("b")))), "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and nothing hangs on a node that hangs."""
    roles = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    each = roles.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 OR (up > 0 AND down > 0)").limit(1).count() == 0
