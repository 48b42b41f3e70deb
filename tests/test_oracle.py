"""Every registered query against its reference SQL on the smallest tables."""

import pytest

from __spark_entry__ import FLAGSHIP, entry, oracle_sql, queries
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    problem, _ = compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert problem is None


def test_entry_has_rows(spark):
    assert FLAGSHIP in queries()
    assert entry(spark).count() > 0
