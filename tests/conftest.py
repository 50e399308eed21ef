import pytest

from verification.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
