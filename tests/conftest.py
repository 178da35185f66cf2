import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def blob():
    import struct

    return lambda *ids: struct.pack(f"<{len(ids)}I", *ids)
