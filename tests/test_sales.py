import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import metrics as M
from sparkloom.operators import backtest as B
from sparkloom.operators import features as X
from sparkloom.operators import panel as P

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n - 1)


def series(spark, days, sales=None, promo=None):
    rows = [(day(d), 1, "a", float(sales[i] if sales else d), promo[i] if promo else 0) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, onpromotion int")


def by_day(df, col):
    return {(r["date"] - DAY).days + 1: r[col] for r in df.collect()}


def test_lag_by_row_and_by_date_differ_after_a_gap(spark):
    x = series(spark, [d for d in range(1, 21) if d != 11])
    row, date = by_day(X.add_lags(x, lags=[7]), "sales_lag_7"), by_day(X.add_lags(x, lags=[7], by="date"), "sales_lag_7")
    assert row[10] == date[10] == 3
    assert row[12] == 4 and date[12] == 5
    assert date[18] is None and row[18] == 10
    assert row[19] == date[19] == 12


def test_rolling_starts_with_one_value(spark):
    x = X.add_rolling(series(spark, range(1, 11)), windows=[14], lags=[7])
    assert by_day(x, "sales_roll_mean_14_lag7")[7] is None
    assert by_day(x, "sales_roll_mean_14_lag7")[8] == 1
    assert by_day(x, "sales_roll_std_14_lag7")[8] == 0
    assert by_day(x, "sales_roll_mean_14_lag7")[10] == 2


def test_windows_up_to_the_lag_are_skipped(spark):
    cols = X.add_rolling(series(spark, [1])).columns
    assert {c for c in cols if "roll_mean" in c} == {"sales_roll_mean_14_lag7", "sales_roll_mean_28_lag7", "sales_roll_mean_28_lag14"}


def test_first_and_priority_holiday(spark):
    h = spark.createDataFrame([(1, DAY, "Event", "Local", False), (2, DAY, "Holiday", "National", True)], "row_id long, date date, type string, locale string, transferred boolean")
    a, b = P.collapse_holidays(h).first(), P.collapse_holidays(h, "priority").first()
    assert (a.holiday_type, a.holiday_locale, a.transferred, a.is_national) == ("Event", "Local", True, True)
    assert (b.holiday_type, b.holiday_locale) == ("Holiday", "National")


def test_event_distance(spark):
    dates = spark.createDataFrame([(day(d),) for d in [*range(1, 13), 60]], "date date")
    events = spark.createDataFrame([(day(5),), (day(9),)], "date date")
    got = {(r["date"] - DAY).days + 1: (r.days_to_holiday, r.days_since_holiday) for r in X.add_event_distance(dates, events).collect()}
    assert got[5] == (0, 30) and got[7] == (2, 2) and got[9] == (0, 4) and got[12] == (30, 3) and got[60] == (30, 30)


def test_oil_gaps(spark):
    oil = spark.createDataFrame([(day(1), None), (day(2), 10.0), (day(5), 13.0)], "date date, dcoilwtico double")
    got = {(r["date"] - DAY).days + 1: (r.oil_price, r.oil_imputed) for r in P.oil_prices(oil, flag=True).collect()}
    assert got == {1: (10.0, 1), 2: (10.0, 0), 3: (10.0, 1), 4: (10.0, 1), 5: (13.0, 0)}


def test_short_folds_are_left_out(spark):
    df = spark.createDataFrame([(day(1),), (day(220),)], "date date")
    got = {r.fold_id: (r.train_end - r.train_start).days for r in B.walk_forward_folds(df).collect()}
    assert got == {0: 203, 1: 187}


def test_folds_do_not_overlap(spark):
    rows = B.walk_forward_folds(spark.createDataFrame([(day(1),), (day(400),)], "date date")).collect()
    assert len(rows) == 3
    for r in rows:
        assert r.train_end < r.val_start and (r.val_end - r.val_start).days == 15


def test_metrics_clip_and_epsilon(spark):
    df = spark.createDataFrame([(0.0, -5.0), (10.0, 10.0), (100.0, 50.0)], "sales double, predicted double")
    r = M.evaluate(df).first()
    assert r.rmsle == pytest.approx(math.sqrt((math.log1p(50) - math.log1p(100)) ** 2 / 3))
    assert r.wape == pytest.approx(55 / (110 + 3e-8))
    assert r.bias == pytest.approx((-5 + 0 - 50) / 3)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(M.clip0(F.col("x"))).collect()] == [None, 0.0, 2.0]


def test_promotion_slices_are_zero_and_one(spark):
    df = spark.createDataFrame([(1.0, 1.0, k) for k in (0, 1, 2)], "sales double, predicted double, onpromotion int")
    assert {r.promotion: r.n_rows for r in M.error_by_promotion(df).collect()} == {"not promoted": 1, "promoted": 1}


def test_no_feature_sees_the_future(spark):
    """Sales changed after day 30 change no feature up to day 30 + 7."""
    days = list(range(1, 61))
    a, b = series(spark, days), series(spark, days, [d if d <= 30 else 1000 for d in days])
    make = lambda x: {r["date"]: tuple(v for k, v in r.asDict().items() if k.startswith("sales_")) for r in X.add_rolling(X.add_lags(x, lags=[7, 14])).collect()}
    x, y = make(a), make(b)
    assert all(x[day(d)] == y[day(d)] for d in range(1, 38))
    assert x[day(38)] != y[day(38)]


def test_series_features_share_one_exchange(spark):
    x = X.add_rolling(X.add_lags(X.add_promo_counts(series(spark, range(1, 40)))))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(store_nbr") == 1
    assert "SinglePartition" not in plan


def test_dimension_joins_do_not_shuffle_the_panel(spark):
    panel = series(spark, range(1, 40))
    stores = spark.createDataFrame([(1, "c", "s", "A", 2)], "store_nbr int, city string, state string, type string, cluster int")
    oil = spark.createDataFrame([(DAY, 1.0)], "date date, dcoilwtico double")
    events = spark.createDataFrame([(1, DAY, "Event", "Local", False)], "row_id long, date date, type string, locale string, transferred boolean")
    tx = spark.createDataFrame([(DAY, 1, 5)], "date date, store_nbr int, transactions long")
    train, _ = P.build_master(P.SalesTables(panel, panel.drop("sales"), stores, oil, events, tx))
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3
    assert train.count() == 39
    assert train.filter("is_holiday = 1").count() == 1


def test_empty_panel(spark):
    empty = series(spark, [1]).limit(0)
    assert X.add_rolling(X.add_lags(empty)).count() == 0
    assert B.walk_forward_folds(empty).count() == 0


def test_blend_clips(spark):
    df = spark.createDataFrame([(-10.0, 5.0)], "a double, b double")
    r = df.select(B.blend(["a", "b"], [0.6, 0.4]).alias("x"), B.blend(["a", "b"], [0.6, 0.4], "members").alias("y")).first()
    assert r.x == 0 and r.y == pytest.approx(2.0)


def test_codes_of_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "family string")
    assert {r.family: r.family_code for r in X.add_codes(df, ["family"]).collect()} == {"a": 0, "b": 1, None: -1}
