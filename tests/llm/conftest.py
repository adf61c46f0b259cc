import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA
