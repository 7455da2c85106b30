import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from samplewright.session import local_session  # noqa: E402
from samplewright.shipping import ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, app="tests", shuffle_partitions=4)
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
