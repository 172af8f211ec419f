"""Column functions with the engine's conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an unreachable vertex shows at the boundary; inside it is null, so nothing is ever added to it.
UNREACHABLE = 2147483647


def shown_distance(distance: Column) -> Column:
    return F.coalesce(distance, F.lit(UNREACHABLE)).cast("int")


def inner_distance(distance: Column) -> Column:
    return F.when(distance != UNREACHABLE, distance)


def log_count(x: Column) -> Column:
    """``ln(x + 1)``, with 0 kept at 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.log1p(x))


def nearest(x: Column, centroids: list[tuple[int, float]]) -> Column:
    """The cluster whose centroid is nearest, of equally near ones the lowest: no join, one expression."""
    options = [F.struct(F.abs(x - F.lit(float(c))).alias("d"), F.lit(k).alias("cluster")) for k, c in centroids]
    return F.array_min(F.array(*options))["cluster"]
