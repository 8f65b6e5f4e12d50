import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    build = SparkSession.builder.master("local[4]").appName("graphmine-tests")
    for k, v in {
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
    }.items():
        build = build.config(k, v)
    session = build.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
