import pytest

from spanloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("spanloom-tests", 4, 2)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
