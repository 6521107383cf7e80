import pytest
import twins

from quire.plans import core_queries


@pytest.mark.skipif(twins.missing(), reason="no test tables")
def test_core_queries_equal_their_sql(spark):
    q, sql = core_queries.queries(), core_queries.oracle_sql()
    assert set(sql) <= set(q)
    assert twins.differences(spark, q, sql) == []


@pytest.mark.skipif(twins.missing(), reason="no test tables")
def test_queries_without_sql_run(spark):
    q, sql = core_queries.queries(), core_queries.oracle_sql()
    for n in set(q) - set(sql):
        assert q[n](spark, twins.SF).count() > 0, n


def test_entry(spark):
    import __spark_entry__ as e

    if not twins.missing():
        assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
