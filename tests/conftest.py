import pytest

from sparkmetrica.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", cores="8")

