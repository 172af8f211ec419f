"""Basic edge operators: cut-off, reversal, degrees, adjacency, the chain graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def below(edges: DataFrame, max_id: int | None) -> DataFrame:
    """Edges with both ids under ``max_id``; None keeps all."""
    return edges if max_id is None else edges.where((F.col("follower") < max_id) & (F.col("followed") < max_id))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("followed").alias("src"), F.col("follower").alias("dst"))


def tagged(edges: DataFrame) -> DataFrame:
    """Each edge once under either end: ``id, tag, other``; one pass over the edges."""
    ends = F.array(F.struct(F.col("followed").alias("id"), F.lit("TO").alias("tag"), F.col("follower").alias("other")), F.struct(F.col("follower").alias("id"), F.lit("FROM").alias("tag"), F.col("followed").alias("other")))
    return edges.select(F.inline(ends))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, n_in, n_out`` for every id on an edge: one aggregation of the tagged edges, combined before the shuffle."""
    count = lambda tag: F.count(F.when(F.col("tag") == tag, 1))
    return tagged(edges).groupBy("id").agg(count("TO").alias("n_in"), count("FROM").alias("n_out"))


def two_path_cardinality(edges: DataFrame) -> DataFrame:
    """Rows of the two-path join, from degrees alone."""
    return degrees(edges).agg(F.coalesce(F.sum(F.col("n_in") * F.col("n_out")), F.lit(0)).cast("long").alias("cardinality"))


def vertices(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct ids of nodes and edges."""
    return nodes.select("id").unionByName(tagged(edges).select("id")).distinct()


def adjacency(edges: DataFrame, nodes: DataFrame, kind: str = "list") -> DataFrame:
    """``id, adj`` for ids of nodes and followers; followed-only ids have no row. Lists are sorted; sets are distinct too."""
    gather = {"list": F.collect_list, "set": F.collect_set}[kind]
    rows = nodes.select("id", F.lit(None).cast("int").alias("to")).unionByName(edges.select(F.col("follower").alias("id"), F.col("followed").alias("to")))
    return rows.groupBy("id").agg(F.array_sort(gather("to")).alias("adj"))


def nested_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges joined to the node they follow, as two nested columns ``_1`` and ``_2``."""
    pairs = edges.join(nodes, F.col("followed") == F.col("id"))
    return pairs.select(F.struct("follower", "followed").alias("_1"), F.struct("id").alias("_2"))


def chain_graph(spark: SparkSession, k: int) -> DataFrame:
    """``k`` chains of ``k`` vertices whose last ones lead to vertex 0: ``src, dst``."""
    if k < 1:
        raise ValueError(f"k: {k}")
    n = spark.range(1, k * k + 1)
    return n.select(F.col("id").cast("int").alias("src"), F.when(F.col("id") % k == 0, 0).otherwise(F.col("id") + 1).cast("int").alias("dst"))
