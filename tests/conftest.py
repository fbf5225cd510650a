import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="spendlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from spendlens.suite.compare import duck_connection
    return duck_connection(SF_SMALL)
