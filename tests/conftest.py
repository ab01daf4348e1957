import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from kohort.session import build_session

    session = build_session("kohort-tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def customers(spark):
    """Customers of the 0.01 data set: enough rows to fit models on."""
    from kohort.checks.base import c360

    return c360(spark, "/root/testdata/sf0.01")
