import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tableprep-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def dirty(spark):
    """Five rows: one missing age and income, a placeholder city, a missing note, one duplicate row."""
    from tableprep import with_row_order

    rows = [
        (1, 25.0, 40000.0, "Seattle", "ok", "yes"),
        (2, None, 52000.0, "unknown", None, "no"),
        (3, 41.0, None, "Austin", "?", "no"),
        (4, 37.0, 999999.0, "Chicago", "a long free text note that goes on and on for some time", "yes"),
        (5, 25.0, 40000.0, "Seattle", "ok", "yes"),
    ]
    df = spark.createDataFrame(rows, "n int, age double, income double, city string, notes string, target string")
    return with_row_order(df, "n").drop("n")


@pytest.fixture(scope="session")
def drifted(spark):
    schema = "age bigint, income bigint, city string, target string"
    train = [(25, 40, "Seattle", "no"), (30, 45, "Austin", "no"), (35, 50, "Chicago", "no"), (28, 42, "Seattle", "no"), (33, 48, "Austin", "yes")]
    test = [(25, 40, "Seattle", "no"), (70, 150, "Miami", "yes"), (72, 160, "Denver", "yes"), (68, 155, "Miami", "yes"), (75, 170, "Austin", "yes")]
    return spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)
