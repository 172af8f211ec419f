import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


MINI = [(1, 2), (2, 4), (2, 3), (3, 1), (4, 5), (5, 2), (6, 7), (7, 8)]


@pytest.fixture(scope="session")
def mini_edges(spark):
    return spark.createDataFrame(MINI, "follower int, followed int")


@pytest.fixture(scope="session")
def mini_nodes(spark):
    return spark.createDataFrame([(i,) for i in range(1, 10)], "id int")
