import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablefacts.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("tablefacts-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def harvest(spark):
    rows = [
        ("Hill", "apple", 4000, 5), ("Hill", "pear", 2500, 4), ("Lake", "apple", 6000, 7), ("Lake", "plum", 1500, 3),
        ("Mill", "pear", 3500, 6), ("Mill", "plum", 500, 2), ("Hill", "plum", 3000, 3), ("Lake", "pear", 2000, 5),
        ("Mill", "apple", 2000, 4), ("Dune", "apple", 0, 1),
    ]
    return spark.createDataFrame(rows, "Orchard string, Fruit string, Crates bigint, `Crew Size` bigint")


@pytest.fixture(scope="session")
def visits(spark):
    rows = [
        ("W1", "north", 1200, 10.0), ("W1", "south", 800, 20.0), ("W2", "north", 1500, 0.5),
        ("W2", "south", 500, 4.5), ("W3", "north", 900, 30.0), ("W3", "south", 1100, 25.0),
    ]
    return spark.createDataFrame(rows, "Week string, Gate string, Visitors bigint, `Rain %` double")
