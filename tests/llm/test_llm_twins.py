import importlib.util

import pytest
import twins

from quire.llm import queries

#: What letters end with is learnt, and the smallest tables have ten letters: these are compared on the next ones.
LEARNT = ("p10_found", "p10_rates")


@pytest.mark.skipif(twins.missing(), reason="no test tables")
def test_llm_queries_equal_their_sql(spark, monkeypatch):
    sql = queries.oracle_sql()
    assert twins.differences(spark, queries.queries(), {k: v for k, v in sql.items() if k not in LEARNT}) == []
    monkeypatch.setattr(twins, "SF", twins.SF.replace("sf0.001", "sf0.01"))
    assert twins.differences(spark, queries.queries(), {k: sql[k] for k in LEARNT}) == []


@pytest.mark.skipif(twins.missing(), reason="no test tables")
def test_queries_without_sql_run(spark):
    q, sql = queries.queries(), queries.oracle_sql()
    for n in set(q) - set(sql):
        assert q[n](spark, twins.SF).count() >= 0, n


def test_subpackage_is_found():
    assert importlib.util.find_spec("quire.llm")
