"""Distances from several sources by breadth-first search over a frontier.

A pass joins only the rows reached last with the edges and keeps what was not
reached before, so traffic follows the frontier, not the graph. Sources, ids
and distances are rows, for any number of sources.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import UNREACHABLE, shown_distance
from tessera.operators.graph import vertices
from tessera.plans.loop import cut
from tessera.sources import files


@dataclass
class Reached:
    """``reached(id, source, dist)``; ``updates`` of each pass, the last of them 0 where the search ended by itself."""

    reached: DataFrame
    updates: list[int]

    @property
    def passes(self) -> int:
        return len(self.updates)

    @property
    def eccentricity(self) -> int:
        return sum(u > 0 for u in self.updates)


def start(all_ids: DataFrame, sources: list[int]) -> DataFrame:
    """``id, source, dist``: 0 at the source, null elsewhere."""
    sides = F.explode(F.array(*(F.lit(s).cast("int") for s in sources)))
    return all_ids.select("id", sides.alias("source")).withColumn("dist", F.when(F.col("id") == F.col("source"), 0).cast("int"))


def expand(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop: smallest distance of each (id, source) over out-neighbours and the rows themselves."""
    hop = frontier.where("dist IS NOT NULL").join(edges, frontier.id == edges.follower).select(F.col("followed").alias("id"), "source", (F.col("dist") + 1).alias("dist"))
    return frontier.unionByName(hop).groupBy("id", "source").agg(F.min("dist").alias("dist"))


def search(edges: DataFrame, sources: list[int], max_passes: int | None = None) -> Reached:
    if not sources:
        raise ValueError("no sources")
    spark = edges.sparkSession
    links = cut(edges.select("follower", "followed").distinct())
    frontier = spark.createDataFrame([(s, s, 0) for s in sorted(set(sources))], "id int, source int, dist int")
    reached, updates = frontier, []
    while max_passes is None or len(updates) < max_passes:
        hop = frontier.join(links, frontier.id == links.follower).select(F.col("followed").alias("id"), "source", F.lit(len(updates) + 1).alias("dist")).distinct()
        frontier = cut(hop.join(reached, ["id", "source"], "left_anti").select("id", "source", "dist"))
        updates.append(frontier.count())
        if not updates[-1]:
            break
        reached = reached.unionByName(frontier)
    return Reached(reached, updates)


def distances(edges: DataFrame, nodes: DataFrame, sources: list[int], max_passes: int | None = None) -> DataFrame:
    """``id, source, dist`` for every vertex and source, unreachable ones with the sentinel."""
    found = search(edges, sources, max_passes).reached
    return start(vertices(edges, nodes), sources).drop("dist").join(found, ["id", "source"], "left").withColumn("dist", shown_distance(F.col("dist")))


def wide(dist: DataFrame, sources: list[int]) -> DataFrame:
    """One row per id with columns ``d1, d2, ...`` in the order of ``sources``."""
    columns = [F.min(F.when(F.col("source") == s, F.col("dist"))).alias(f"d{k}") for k, s in enumerate(sources, 1)]
    return dist.groupBy("id").agg(*columns)


def states(edges: DataFrame, adjacent: DataFrame, dist: DataFrame) -> DataFrame:
    """Vertex records: ``id, sourcesDistance, isVertex, adjacencyList``; targets without a record get an empty list."""
    maps = dist.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("source").cast("string"), "dist")))).alias("sourcesDistance"))
    joined = maps.join(adjacent, "id", "left")
    return joined.select("id", "sourcesDistance", F.lit(True).alias("isVertex"), F.coalesce("adj", F.array().cast("array<int>")).alias("adjacencyList"))


def first_states(edges: DataFrame, nodes: DataFrame, adjacent: DataFrame, sources: list[int]) -> DataFrame:
    """Vertex records before the first pass: 0 at its own source, else the sentinel."""
    all_ids = start(vertices(edges, nodes), sources)
    return states(edges, adjacent, all_ids.withColumn("dist", shown_distance(F.col("dist"))))


def message_pass(records: DataFrame) -> DataFrame:
    """One pass over vertex records: each sends its distances, one hop on, to its list, and keeps the least of what it has and gets.

    ``records`` and the result are ``id, sourcesDistance, isVertex, adjacencyList``
    with ``updated``, the number of a record's distances that went down. Messages
    are combined before the shuffle; records without messages stay as they are.
    """
    known = records.select("id", F.explode("sourcesDistance").alias("source", "dist"))
    sent = records.select(F.explode(F.array_distinct("adjacencyList")).alias("id"), F.explode(F.map_filter("sourcesDistance", lambda _, d: d < UNREACHABLE)).alias("source", "dist"))
    least = sent.groupBy("id", "source").agg(F.min(F.col("dist") + 1).alias("new"))
    merged = known.join(least, ["id", "source"], "left").select("id", "source", F.least("dist", "new").alias("dist"), F.coalesce(F.col("new") < F.col("dist"), F.lit(False)).cast("int").alias("down"))
    maps = merged.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "dist")))).alias("sourcesDistance"), F.sum("down").alias("updated"))
    return records.select("id", "isVertex", "adjacencyList").join(maps, "id").select("id", "sourcesDistance", "isVertex", "adjacencyList", "updated")


def run_states(records: DataFrame, out: str, max_passes: int | None = None) -> tuple[DataFrame, list[int]]:
    """Passes over text files of vertex records until no distance goes down: pass ``i`` reads the folder ``out-<i>`` and writes ``out-<i + 1>``.

    Returns the last records and the updates of each pass. A run can go on from any of its folders.
    """
    spark, updates = records.sparkSession, []
    files.write_lines(records, f"{out}-0", files.state_line())
    while max_passes is None or len(updates) < max_passes:
        passed = cut(message_pass(files.parse_state(spark.read.text(f"{out}-{len(updates)}"))))
        updates.append(passed.agg(F.coalesce(F.sum("updated"), F.lit(0))).first()[0])
        files.write_lines(passed, f"{out}-{len(updates)}", files.state_line())
        if not updates[-1]:
            break
    return files.parse_state(spark.read.text(f"{out}-{len(updates)}")), updates
