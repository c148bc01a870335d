import pytest

from purlin.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cores=4, shuffle_partitions=4, memory="3g")
    yield session
    session.stop()
