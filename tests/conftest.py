import pytest

from corpusmill.session import local_session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("tests", 4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    ship(s)
    return s
