import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", "/tmp/assay-warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def pytest_configure(config):
    session()  # columns can't be built before


@pytest.fixture(scope="session")
def spark():
    return session()
