import pytest

from shotloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("local[4]", 4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
