import pytest

from pointloom.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", 4, "3g")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))
    return session
