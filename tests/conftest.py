import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import prepare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def texts(spark):
    """Raw messages from literal texts."""

    def make(*values):
        return spark.createDataFrame([(v,) for v in values], "value string")

    return make


@pytest.fixture
def hot(spark):
    """Lowers the size from which a group is split, so that small data takes that path."""
    from millrace.operators.groups import HOT_GROUP_ROWS

    spark.conf.set(HOT_GROUP_ROWS, "40")
    yield
    spark.conf.unset(HOT_GROUP_ROWS)
