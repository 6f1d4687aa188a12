import pytest

from gristmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("gristmill-tests", "4", 4)
    yield s
    s.stop()
