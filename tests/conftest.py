import pytest

from barquet.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="8", partitions=2, app="barquet-tests")
    yield session
    session.stop()
