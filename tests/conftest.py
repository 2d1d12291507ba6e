import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Run one column function over a list of texts."""
    from pyspark.sql import functions as F

    def run(fn, values, dtype="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, x {dtype}").coalesce(1)
        rows = df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
        return [r["y"] for r in rows]

    return run
