import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "4g")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    yield s
