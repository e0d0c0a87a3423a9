import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import duck, session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session("4", "4")
    from labelaudit.session import configure
    yield configure(spark)
    spark.stop()


@pytest.fixture(scope="session")
def con():
    return duck(SMALL)


@pytest.fixture(scope="session")
def sf():
    return SMALL
