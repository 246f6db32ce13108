import pytest

from ratiocert.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, partitions=2)
