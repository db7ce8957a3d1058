import pytest

from tracewell.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tracewell-tests")
