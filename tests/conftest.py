import pytest

from claimloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("claimloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
