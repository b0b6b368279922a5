import pytest

from tallyline.session import local_session
from tallyline.sources.fixtures import ClubData
from tests.compare import database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data(spark):
    return ClubData(spark, FOLDER)


@pytest.fixture(scope="session")
def con():
    return database(FOLDER)
