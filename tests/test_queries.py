"""Every registered query at the smallest scale, beside its SQL where there is one."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    check = oracle_sql().get(name)
    if check is None:
        assert len(got) > 0
    else:
        assert differences(got, con.sql(check).df()) is None
    spark.catalog.clearCache()
