import os

import pytest

from sparkloom.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores=os.environ.get("TEST_CPUS", str(min(8, os.cpu_count() or 4))), memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
