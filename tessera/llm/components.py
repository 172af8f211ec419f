"""Connected components of links between 64-bit nodes, in DataFrame steps.

Alternating stars: large stars hang every larger neighbour of a node on the
node's smallest neighbour, small stars hang the smaller neighbours on the
smallest. Links only shorten, so a few rounds suffice; every round is written
to the shared folder and the one before it removed. The rounds end when the
links are stars: no node hangs on two others, and none that others hang on
hangs itself. One truth value of each round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, written


def _stars(links: DataFrame) -> bool:
    """Whether ``links`` are a star for each component; ends are counted with map-side combine."""
    ends = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 1 OR (up = 1 AND n > 1)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the smallest node of its component."""
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        if _stars(links):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, links = links, written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(before)
    else:
        raise RuntimeError(f"no stars after {most_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
