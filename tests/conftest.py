import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[4]").appName("judgelens-tests")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "6g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="judgelens-test-ckpt-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    yield spark


@pytest.fixture()
def hot_keys(spark):
    """Force the range-partitioned path for every key bigger than 5 rows."""
    spark.conf.set("judgelens.maxKeyRows", "5")
    yield
    spark.conf.unset("judgelens.maxKeyRows")


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="judgelens-test-")
