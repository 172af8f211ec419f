"""One-dimensional k-means over follower counts.

A pass assigns each point to its nearest centroid (of equally near ones the
lowest), then takes means, and squared errors against the centroids it
assigned by. The centroids are K numbers on the driver and enter the plan as
one literal expression.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import nearest
from tessera.plans.loop import cut
from tessera.sources import files

Centroids = list[tuple[int, float]]


@dataclass
class Clustered:
    centroids: Centroids
    sse: list[float]
    trace: list[tuple[int, int, float, float]]
    totals: list[int]

    @property
    def passes(self) -> int:
        return len(self.totals)


def starts(kind: str, k: int, highest: float, rng: random.Random | None = None, base: float = 10.0) -> Centroids:
    """``spread``: one in each bucket of equal width, its middle without ``rng``. ``clumped``: base, base + 1, and so on."""
    if kind == "spread":
        width = math.ceil(highest / k)
        return [(i + 1, i * width + (rng.random() * width if rng else width / 2)) for i in range(k)]
    if kind == "clumped":
        first = rng.random() * (highest - k) if rng else base
        return [(i + 1, first + i) for i in range(k)]
    raise ValueError(f"start: {kind}")


def assign(points: DataFrame, centroids: Centroids) -> DataFrame:
    return points.withColumn("cluster", nearest(F.col("x"), centroids))


def step(points: DataFrame, centroids: Centroids) -> dict[int, tuple[float, float]]:
    """Mean and squared error of each cluster that has points: one aggregation, K rows to the driver."""
    old = F.element_at(F.array(*(F.lit(float(c)) for _, c in centroids)), F.col("at"))
    place = {k: i + 1 for i, (k, _) in enumerate(centroids)}
    at = F.element_at(F.create_map(*(F.lit(x) for pair in place.items() for x in pair)), F.col("cluster"))
    rows = assign(points, centroids).withColumn("at", at)
    found = rows.groupBy("cluster").agg(F.avg("x").alias("mean"), F.sum(F.pow(F.col("x") - old, 2)).alias("sse")).collect()
    return {r.cluster: (r["mean"], r.sse) for r in found}


def seeded(seed: int, highest: float = 564_512.0) -> Callable[[int, float], float]:
    """New centroids for empty clusters: drawn evenly from [0, ``highest``) by a hash of seed, cluster and old centroid, so reruns agree."""
    return lambda k, c: int(hashlib.md5(f"{seed}:{k}:{c:.6f}".encode()).hexdigest()[:8], 16) / 2**32 * highest


def run(points: DataFrame, start: Centroids, tol: float = 2.0, max_passes: int | None = 10, reseed: Callable[[int, float], float] | None = None, out: str | None = None) -> Clustered:
    """Passes until the total error moves by ``tol`` or less. An empty cluster keeps its centroid unless ``reseed`` names another.

    With ``out`` every pass writes its ``cluster,centroid,sse`` to the folder
    ``out-<pass>``, and the next pass reads its centroids from there.
    """
    points = cut(points.select("id", "x"))
    centroids, totals, trace, last, move = list(start), [], [], 0.0, tol + 1
    while move > tol and (max_passes is None or len(totals) < max_passes):
        if out and totals:
            centroids = read_pass(points.sparkSession, f"{out}-{len(totals)}")
        found = step(points, centroids)
        new, sse = [], []
        for k, c in centroids:
            mean, error = found.get(k, (reseed(k, c) if reseed else c, 0.0))
            new.append((k, mean))
            sse.append(error)
        totals.append(sum(int(e) for e in sse))
        trace += [(len(totals), k, c, e) for (k, c), e in zip(new, sse, strict=True)]
        move, last, centroids = abs(totals[-1] - last), float(totals[-1]), new
        if out:
            rows = [(k, float(c), float(e)) for (k, c), e in zip(new, sse, strict=True)]
            files.write_csv(points.sparkSession.createDataFrame(rows, "cluster int, centroid double, sse double"), f"{out}-{len(totals)}", single_file=True, shuffle=False)
    return Clustered(centroids, sse, trace, totals)


def read_pass(spark: SparkSession, path: str) -> Centroids:
    """The centroids that a pass wrote."""
    return [(r.cluster, r.centroid) for r in files.read_centroids(spark, path).orderBy("cluster").collect()]
