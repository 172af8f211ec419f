"""The follower graph that the driver's tables hold: parts are ids, a customer follows the parts of its orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("int").alias("id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followed ids are folded onto the customers' range, so that the graph has one kind of vertex."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    joined = orders.join(items, orders.o_orderkey == items.l_orderkey)
    return joined.select(F.col("o_custkey").cast("int").alias("follower"), (F.col("l_partkey") % F.lit(customers)).cast("int").alias("followed"))
