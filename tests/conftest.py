"""One session for all tests."""

import pytest

from depotflow.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, app="tests", memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    from depotflow.sources.star import StarWarehouse

    return StarWarehouse(spark, SF)
