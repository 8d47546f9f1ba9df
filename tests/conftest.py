import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tideline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture
def values(spark):
    """Evaluate column expressions over a list of texts (or other scalars)."""
    def run(column, items, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
        return [r[0] for r in df.orderBy("i").select(column).collect()]

    return run
