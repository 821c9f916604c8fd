import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    session = make_session(8)
    yield session
    session.stop()
