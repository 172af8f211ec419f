"""Follower counts, in the sum form (zero where nobody follows) and the row form, and their distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import log_count


def contributions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One for each edge, zero for each node, so that no node is missing."""
    return edges.select(F.col("followed").alias("id"), F.lit(1).alias("one")).unionByName(nodes.select("id", F.lit(0).alias("one")))


def follower_count(edges: DataFrame, nodes: DataFrame, how: str = "reduce") -> DataFrame:
    """``id, cnt``.

    ``reduce``, ``fold`` and ``aggregate`` are one plan: sums combined before
    the shuffle. ``group`` is the form without combining: it gathers a key's
    values first, for comparison only, as a popular key's list is long.
    """
    rows = contributions(edges, nodes)
    if how in ("reduce", "fold", "aggregate"):
        return rows.groupBy("id").agg(F.coalesce(F.sum("one"), F.lit(0)).cast("long").alias("cnt"))
    if how == "group":
        values = F.collect_list("one")
        return rows.groupBy("id").agg(F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x).alias("cnt"))
    if how == "double":
        return rows.groupBy("id").agg(F.sum(F.col("one").cast("double")).alias("cnt"))
    raise ValueError(f"how: {how}")


def follower_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows per id: followers, and one more for a listed node."""
    return contributions(edges, nodes).groupBy("id").agg(F.count(F.lit(1)).alias("cnt"))


def histogram(counts: DataFrame) -> DataFrame:
    """``followers, users``"""
    return counts.groupBy(F.col("cnt").alias("followers")).agg(F.count(F.lit(1)).alias("users"))


def points(found: DataFrame) -> DataFrame:
    """The points of the distribution chart, from ``followers, users``."""
    return found.select(F.round(log_count(F.col("followers")), 9).alias("x"), F.round(F.log("users"), 9).alias("y"))


def loglog(counts: DataFrame) -> DataFrame:
    return points(histogram(counts))
