import pytest
from oracle import DATA, connect, same

from sparkloom.plans.testtables import together
from sparkloom.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    with together():
        yield connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, DATA), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, con, name):
    # a year's lag needs more than a year of sales
    data = DATA.replace("0.001", "0.01") if name in ("gbt_backtest", "gbt_forecast", "feature_importance") else DATA
    with together():
        assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())
