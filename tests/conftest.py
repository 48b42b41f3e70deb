import pytest

from wayfind.config import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "wayfind-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as plain tuples, sorted."""
    return sorted(tuple(r) for r in (df.select(*order) if order else df).collect())
