import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairwell.session import configure  # noqa: E402
from suite.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = configure(session(8))
    yield spark
    spark.stop()


@pytest.fixture(params=["3", "8"])
def partitions(request, spark):
    """Run a test under different numbers of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
