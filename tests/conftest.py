import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    scratch = tempfile.mkdtemp(prefix="sluice-tests-", dir="/tmp")
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", scratch + "/ckpt")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from sluice.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)


def feed_of(spark, rows, schema, order="i"):
    from sluice.feed import Feed
    return Feed.from_table(spark.createDataFrame(rows, schema), order)


def ordered_values(feed, column):
    """Items in feed order (test helper: small data only)."""
    return [r[column] for r in feed.ordered().select(column).collect()]
