"""Every registered query against its SQL, over the whole small tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[:3] == ["profile_id", "match_rank", "scheme_id"]
    assert out.count() > 0
