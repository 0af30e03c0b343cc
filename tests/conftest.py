import pytest

from tests.oracle import local_spark


@pytest.fixture(scope="session")
def spark():
    return local_spark()
