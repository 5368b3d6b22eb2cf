import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import backtest as B
from sparkloom.operators import features as X
from sparkloom.operators import forecast as C

COLS = ["store_nbr", "day_of_week", "sales_lag_7", "sales_lag_14"]


@pytest.fixture(scope="module")
def panel(spark):
    """Two series of 240 days with a weekly pattern and a trend."""
    rows = [(dt.date(2021, 1, 1) + dt.timedelta(days=d), s, "a", 10.0 * s + 5 * (d % 7) + 0.05 * d + 2 * math.sin(d), d % 2) for s in (1, 2) for d in range(240)]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, onpromotion int")
    return X.add_lags(X.add_calendar(df), lags=[7, 14]).withColumn("id", F.monotonically_increasing_id()).persist()


def test_boosted_trees_beat_zero_and_come_near_the_naive(panel):
    folds = B.walk_forward_folds(panel, n=2)
    out = C.backtest(panel, folds, COLS, n_folds=3, rounds=15, depth=4)
    errors = {r.fold_id: r for r in C.backtest_errors(out).collect()}
    naive = {r.fold_id: r for r in B.naive_backtest(panel, folds, "sales_lag_7").collect()}
    assert set(errors) == {0, 1} and errors[0].n_rows == 32
    assert all(errors[i].rmsle < naive[i].rmsle + 0.15 for i in errors)
    assert out.filter("predicted < 0").count() == 0


def test_forecast_fills_or_drops_gaps(panel):
    last = panel.agg(F.max("date")).first()[0]
    test = panel.filter(F.col("date") > F.date_sub(F.lit(last), 10)).withColumn("sales", F.lit(None).cast("double"))
    gap = test.withColumn("sales_lag_14", F.when(F.dayofmonth("date") % 2 == 0, F.col("sales_lag_14")))
    train = panel.filter(F.col("date") <= F.date_sub(F.lit(last), 10))
    full = C.forecast(train, gap, COLS, rounds=3, depth=3)
    some = C.forecast(train, gap, COLS, rounds=3, depth=3, on_missing="drop")
    assert full.count() == some.count() == test.count()
    assert full.filter("sales = 0").count() == 0 and some.filter("sales = 0").count() > 0


def test_importance_is_ranked(panel):
    rows = X.drop_incomplete(panel, COLS)
    best = C.feature_importance(C.fit_gbt(rows, COLS, rounds=3, depth=3), COLS, n=2).collect()
    assert len(best) == 2 and best[0].importance >= best[1].importance and best[0].feature.startswith("sales_lag")
