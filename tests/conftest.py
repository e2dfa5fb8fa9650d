import pytest

from parcelgrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    s.sparkContext.setLogLevel("ERROR")
    return s
