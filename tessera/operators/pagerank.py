"""PageRank without damping, with the rank of dead ends dealt out evenly.

Vertex 0 collects what leaves the graph; every pass its rank is spread over
the real vertices. On a graph with several out-edges a vertex splits its rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.loop import cut


@dataclass
class Ranked:
    ranks: DataFrame
    deltas: list[float]
    sums: list[float]


def initial(links: DataFrame) -> DataFrame:
    """``v, pr``: an even share for each real vertex, 0.0 for vertex 0."""
    real = links.select(F.explode(F.array("src", "dst")).alias("v")).where("v <> 0").distinct()
    n = real.count()
    zero = links.sparkSession.range(1).select(F.lit(0).cast("int").alias("v"), F.lit(0.0).alias("pr"))
    return real.select("v", F.lit(1.0 / max(n, 1)).alias("pr")).unionByName(zero)


def run(links: DataFrame, passes: int = 10) -> Ranked:
    """Ranks after ``passes`` of ``links(src, dst)``.

    The links are dealt by source once and written with their out-degree; each
    pass moves ranks to them. A rank-0 row for every vertex keeps those without
    in-edges. Each pass brings one row to the driver.
    """
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    graph = cut(links.join(out, "src").repartition("src"))
    ranks = cut(initial(links))
    n, deltas, sums = ranks.count() - 1, [], []
    for _ in range(passes):
        sent = graph.join(ranks, graph.src == ranks.v).select(F.col("dst").alias("v"), (F.col("pr") / F.col("degree")).alias("pr"))
        dead = ranks.join(out, ranks.v == out.src, "left_anti").where("v <> 0").select(F.lit(0).cast("int").alias("v"), "pr")
        arrived = cut(ranks.select("v", F.lit(0.0).alias("pr")).unionByName(sent).unionByName(dead).groupBy("v").agg(F.sum("pr").alias("pr")))
        delta = arrived.where("v = 0").first().pr
        ranks = arrived.select("v", F.when(F.col("v") == 0, 0.0).otherwise(F.lit(delta / n) + F.col("pr")).alias("pr"))
        deltas.append(delta)
        sums.append(ranks.agg(F.sum("pr")).first()[0])
    return Ranked(ranks, deltas, sums)


def top(ranks: DataFrame, k: int, digits: int = 12) -> DataFrame:
    """The ``k`` highest ranks, by rounded rank and then id."""
    return ranks.select("v", F.round("pr", digits).alias("pr")).orderBy(F.desc("pr"), "v").limit(k)
