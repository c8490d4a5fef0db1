import pytest

from tallyhouse.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture()
def small():
    """Folder of the smallest tables."""
    return "/root/testdata/sf0.001"
