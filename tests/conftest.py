import pytest

from framelens.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tests", spark__sql__shuffle__partitions="4")
