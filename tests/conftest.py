import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from storelens.session import local_session

    s = local_session("*", shuffle_partitions=8, app="storelens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def model_small(spark):
    from storelens.sources.binding import bind_test_tables

    return bind_test_tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def model_mid(spark):
    from storelens.sources.binding import bind_test_tables

    return bind_test_tables(spark, SF_MID)
