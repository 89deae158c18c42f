import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cellframe.session import local_session
    s = local_session("*", 8, "cellframe-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from oracle_check import duck as mk
    return mk(SF01)
