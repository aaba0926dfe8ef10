import pytest

from canvass.session import local_session, local_table

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", **{"spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows and a DDL schema to a DataFrame."""
    return lambda rows, columns: local_table(spark, rows, columns)


@pytest.fixture(scope="session")
def values(spark):
    """The single column of a result, in order."""
    return lambda df: [r[0] for r in df.collect()]
