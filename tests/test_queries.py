import pytest

from tests.oracle import connection, same
from tidemark.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
EMPTY = {"range_lookup_empty", "agg_empty_grouped"}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    n = same(QUERIES[name](spark, SF), con, ORACLE[name])
    assert (n == 0) == (name in EMPTY)
