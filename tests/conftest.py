import pytest

from tidemill.session import session


@pytest.fixture(scope="session")
def spark():
    held = session("tests", 8)
    held.sparkContext.setLogLevel("ERROR")
    held.conf.set("spark.sql.shuffle.partitions", "4")
    return held
