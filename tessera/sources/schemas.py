"""Declared schemas of the files that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

NODE = T.StructType([T.StructField("id", T.IntegerType(), False)])
EDGE = T.StructType([T.StructField("follower", T.IntegerType(), False), T.StructField("followed", T.IntegerType(), False)])
ADJACENCY = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("adj", T.ArrayType(T.IntegerType(), False), False)])
STATE = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("sourcesDistance", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("isVertex", T.BooleanType()),
    T.StructField("adjacencyList", T.ArrayType(T.IntegerType())),
])
POINT = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("x", T.DoubleType(), False)])
CENTROID = T.StructType([T.StructField("cluster", T.IntegerType(), False), T.StructField("centroid", T.DoubleType(), False), T.StructField("sse", T.DoubleType(), False)])
HISTOGRAM = T.StructType([T.StructField("followers", T.DoubleType(), False), T.StructField("users", T.LongType(), False)])
