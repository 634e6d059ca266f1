"""Every registered query against its SQL, on the smallest given tables."""

import pytest
from compare import difference, duck

from chartspark.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, con):
    assert difference(QUERIES[name](spark, SF), con, SQL.get(name)) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
