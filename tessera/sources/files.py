"""Readers and writers: CSV, plain text, adjacency text and vertex-state text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import schemas


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """One integer id per line. Malformed lines raise."""
    return spark.read.schema(schemas.NODE).option("mode", "FAILFAST").csv(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``follower,followed`` lines without a header. Malformed lines raise."""
    return spark.read.schema(schemas.EDGE).option("mode", "FAILFAST").csv(path)


def read_edges_text(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """The same through the text reader: split each line, cast the parts."""
    parts = F.split("value", separator)
    return spark.read.text(path).select(parts[0].cast("int").alias("follower"), parts[1].cast("int").alias("followed"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POINT).option("mode", "FAILFAST").csv(path)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CENTROID).option("mode", "FAILFAST").csv(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """``followers,users`` lines, the input of the distribution chart."""
    return spark.read.schema(schemas.HISTOGRAM).option("mode", "FAILFAST").csv(path)


def read_tagged(*parts: tuple[DataFrame, str]) -> DataFrame:
    """Several inputs as one relation, each row under the tag of its input."""
    tagged = [df.withColumn("tag", F.lit(tag)) for df, tag in parts]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def adjacency_line(id_col: str = "id", adj_col: str = "adj") -> Column:
    """``id-(a:b:c)``; ``id-()`` for an empty list."""
    return F.concat(F.col(id_col).cast("string"), F.lit("-("), F.array_join(F.col(adj_col).cast("array<string>"), ":"), F.lit(")"))


def parse_adjacency(lines: DataFrame, with_self: bool = False) -> DataFrame:
    """``id, adj`` from adjacency lines in column ``value``; ``with_self`` puts the id before its list."""
    body = F.regexp_extract("value", r"\(([^)]*)\)", 1)
    adj = F.transform(F.filter(F.split(body, ":"), lambda x: x != ""), lambda x: x.cast("int"))
    out = lines.select(F.split("value", "-")[0].cast("int").alias("id"), adj.alias("adj"))
    return out.withColumn("adj", F.array_prepend("adj", F.col("id"))) if with_self else out


def state_line() -> Column:
    """``id-{json}`` from the columns of :data:`schemas.STATE`."""
    return F.concat(F.col("id").cast("string"), F.lit("-"), F.to_json(F.struct("id", "sourcesDistance", "isVertex", "adjacencyList")))


def parse_state(lines: DataFrame) -> DataFrame:
    json = F.regexp_extract("value", r"^[^-]*-(.*)$", 1)
    return lines.select(F.from_json(json, schemas.STATE).alias("s")).select("s.*")


def write_lines(df: DataFrame, path: str, line: Column) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, header: bool = False, single_file: bool = False, shuffle: bool = True) -> None:
    """CSV sink. One file only where it is asked for: that is one task's work, whatever the size."""
    if single_file:
        df = df.repartition(1) if shuffle else df.coalesce(1)
    df.write.mode("overwrite").option("header", str(header).lower()).csv(path)


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """CSV in key order over all files: dealt by ranges of the keys and sorted within each."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").csv(path)


def write_chart(points: DataFrame, path: str, width: int = 1200, height: int = 800) -> None:
    """A line chart of ``x, y`` as one SVG file, through Spark's writer.

    One point for each pixel column reaches the driver: the mean of those in it.
    """
    spark = points.sparkSession
    box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        line = ""
    else:
        x0, x1, y0, y1 = box
        column = F.floor((F.col("x") - x0) / ((x1 - x0) or 1.0) * (width - 1)).cast("int")
        rows = points.groupBy(column.alias("at")).agg(F.avg("y").alias("y")).orderBy("at").collect()
        line = " ".join(f"{r['at']},{round((height - 1) * (1 - (r['y'] - y0) / ((y1 - y0) or 1.0)), 1)}" for r in rows)
    svg = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><polyline fill="none" stroke="black" points="{line}"/></svg>'
    spark.createDataFrame([(svg,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    jdf = df._jdf
    return df.sparkSession._jvm.PythonSQLUtils.explainString(jdf.queryExecution(), mode)
