import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401  (ships the package to the Python workers)
    from txnspark.session import build_session

    session = build_session("tests", cores=8, shuffle=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def shuffle_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")

    def use(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    yield use
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture
def path(spark):
    from txnspark.session import new_path
    return new_path(spark, "test")
