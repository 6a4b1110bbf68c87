import os

import pytest

from flowquarry.session import get_spark

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = get_spark(8, **{"spark.sql.shuffle.partitions": "3", "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def duck(folder):
    from tests.oracle import connect

    return connect(folder)
