"""Queries over the sales panel, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import backtest as B
from ..operators import features as X
from ..operators import panel as P
from . import testtables as T
from .testtables import alone, round_all, rounded, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str, cols: str = "", tables: bool = True):
    """Register a query with its SQL; ``cols`` are the doubles, rounded on both sides."""

    def put(f):
        QUERIES[name] = alone(lambda spark, d: round_all(f(spark, d)))
        body = rounded(sql, cols) if cols else sql
        ORACLE_SQL[name] = with_tables(body) if tables else body
        return f

    return put


RMSLE = "SQRT(AVG(POW(LN(1 + GREATEST({p}, 0)) - LN(1 + GREATEST({y}, 0)), 2)))"
R, W = RMSLE.format(p="predicted", y="sales"), "SUM(ABS(sales - predicted)) / SUM(ABS(sales) + 1e-8)"
BIAS = "AVG(predicted - sales)"
MASTER_COLS = "date, store_nbr, family, sales, onpromotion, city, state, type, cluster, oil_price, holiday_type, holiday_locale, transferred, is_national, is_holiday, transactions"
_master_cols = MASTER_COLS.split(", ")
SERIES = "(PARTITION BY store_nbr, family ORDER BY date)"


@query("naive_error_by_family", f"SELECT family, {R} AS rmsle, {W} AS wape, COUNT(*) AS n_rows, AVG(sales) AS mean_sales, SUM(sales) AS total_sales FROM predictions GROUP BY family", "rmsle wape mean_sales total_sales")
def _(s, d):
    return M.error_by(T.predictions(s, d), "family")


@query("master_panel", f"SELECT {MASTER_COLS} FROM master", "sales oil_price")
def _(s, d):
    return T.master(s, d).select(*_master_cols)


@query("master_split", (
    "SELECT date > (SELECT MAX(date) FROM sales) - 16 AS is_test, holiday_type, COUNT(*) AS n, COUNT(CASE WHEN date > (SELECT MAX(date) "
    "FROM sales) - 16 THEN NULL ELSE sales END) AS n_sales, SUM(transactions) AS transactions FROM master GROUP BY 1, 2"
))
def _(s, d):
    train, test = P.split_test(P.one_timeline(*P.build_master(T.sales_tables(s, d))))
    return train.unionByName(test).groupBy("is_test", "holiday_type").agg(F.count("*").alias("n"), F.count("sales").alias("n_sales"), F.sum("transactions").alias("transactions"))


@query("holiday_defaults", "SELECT is_holiday, is_national, transferred, holiday_type, holiday_locale, COUNT(*) AS n FROM master GROUP BY ALL")
def _(s, d):
    return T.master(s, d).groupBy("is_holiday", "is_national", "transferred", "holiday_type", "holiday_locale").agg(F.count("*").alias("n"))


@query("collapse_holidays", "SELECT * FROM events_by_day")
def _(s, d):
    return P.collapse_holidays(T.holidays(s, d))


@query("collapse_holidays_priority", (
    "SELECT date, arg_min(type, k) AS holiday_type, arg_min(locale, k) AS holiday_locale, bool_or(transferred) AS transferred, "
    "bool_or(locale = 'National') AS is_national, 1 AS is_holiday FROM (SELECT *, CASE locale WHEN 'National' THEN 0 "
    "WHEN 'Regional' THEN 1 ELSE 2 END * 1000000000000 + row_id AS k FROM holidays) GROUP BY 1"
))
def _(s, d):
    return P.collapse_holidays(T.holidays(s, d), "priority")


@query("oil_daily", (
    "SELECT s.date, d.oil_price, CAST(o.dcoilwtico IS NULL AS INT) AS oil_imputed FROM oil_spine s JOIN oil_days d USING (date) LEFT JOIN oil o "
    "USING (date)"
), "oil_price")
def _(s, d):
    return P.oil_prices(T.oil(s, d), flag=True)


@query("resample_daily_last", (
    "WITH days AS (SELECT CAST(ts AS DATE) AS date, arg_max(value, ts) AS value FROM events GROUP BY 1), spine "
    "AS (SELECT CAST(unnest(generate_series((SELECT MIN(date) FROM days), (SELECT MAX(date) FROM days), INTERVAL 1 DAY)) AS DATE) AS date) "
    "SELECT date, COALESCE(last_value(value IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), NULL) AS value FROM spine LEFT "
    "JOIN days USING (date)"
), "value", False)
def _(s, d):
    return P.resample_daily_last(T.read(s, d, "events"), "value", "ts")


@query("daily_spine_per_series", (
    f"WITH span AS (SELECT store_nbr, family, MIN(date) AS a, MAX(date) AS b FROM sales GROUP BY 1, 2), spine AS (SELECT store_nbr, family, "
    f"CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span) SELECT store_nbr, family, COUNT(*) AS days, "
    f"COUNT(sales) AS sold FROM spine LEFT JOIN sales USING (store_nbr, family, date) GROUP BY 1, 2"
))
def _(s, d):
    return P.daily_spine(T.sales(s, d), keys=X.SERIES).groupBy(*X.SERIES).agg(F.count("*").alias("days"), F.count("sales").alias("sold"))


@query("series_view", "SELECT date, sales, predicted FROM predictions WHERE store_nbr = 3 AND family = (SELECT MIN(family) FROM sales)", "sales predicted")
def _(s, d):
    p = T.predictions(s, d)
    least = F.broadcast(T.sales(s, d).agg(F.min("family").alias("family")))
    return P.series_view(p.join(least, "family").withColumn("family", F.lit("least")), 3, "least")


@query("calendar_features", (
    "SELECT DISTINCT date, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(day(date) AS INT) AS day_of_month, "
    "CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year, CAST(weekofyear(date) AS INT) AS week_of_year, "
    "CAST(quarter(date) AS INT) AS quarter, CAST(dayofyear(date) AS INT) AS day_of_year, CAST(isodow(date) >= 6 AS INT) AS is_weekend, "
    "CAST(day(date) = 1 AS INT) AS is_month_start, CAST(date = last_day(date) AS INT) AS is_month_end, "
    "SIN(2 * PI() * (isodow(date) - 1) / 7) AS dow_sin, COS(2 * PI() * (isodow(date) - 1) / 7) AS dow_cos, "
    "SIN(2 * PI() * month(date) / 12) AS month_sin, COS(2 * PI() * month(date) / 12) AS month_cos FROM sales"
), "dow_sin dow_cos month_sin month_cos")
def _(s, d):
    return X.add_calendar(T.sales(s, d).select("date").distinct())


@query("event_codes", (
    "SELECT holiday_type, CASE holiday_type WHEN 'Holiday' THEN 1 WHEN 'Transfer' THEN 2 WHEN 'Bridge' THEN 3 WHEN 'Additional' THEN 4 "
    "WHEN 'Event' THEN 5 WHEN 'Work Day' THEN 6 ELSE 0 END AS holiday_type_enc, SUM(is_national) AS is_national_holiday, "
    "SUM(transferred) AS is_transferred FROM master GROUP BY 1"
))
def _(s, d):
    return X.add_event_codes(T.master(s, d)).groupBy("holiday_type", "holiday_type_enc").agg(F.sum("is_national_holiday").alias("is_national_holiday"), F.sum("is_transferred").alias("is_transferred"))


@query("ordinal_codes", (
    "SELECT c.family, k.family_code, c.city, CAST(COALESCE(k2.city_code, -1) AS INT) AS city_code, c.n FROM (SELECT family, city, COUNT(*) AS n "
    "FROM master GROUP BY 1, 2) c JOIN (SELECT family, CAST(dense_rank() OVER (ORDER BY family) - 1 AS INT) AS family_code "
    "FROM (SELECT DISTINCT family FROM master)) k USING (family) LEFT JOIN (SELECT city, dense_rank() OVER (ORDER BY city) - 1 AS city_code "
    "FROM (SELECT DISTINCT city FROM master WHERE city IS NOT NULL)) k2 USING (city)"
))
def _(s, d):
    return X.add_codes(T.master(s, d), ["family", "city"]).groupBy("family", "family_code", "city", "city_code").agg(F.count("*").alias("n"))


@query("event_distance", (
    "SELECT date, LEAST(COALESCE(date_diff('day', date, (SELECT MIN(h.date) FROM events_by_day h WHERE h.date >= x.date)), 99), "
    "30) AS days_to_holiday, LEAST(COALESCE(date_diff('day', (SELECT MAX(h.date) FROM events_by_day h WHERE h.date < x.date), date), 99), "
    "30) AS days_since_holiday FROM (SELECT DISTINCT date FROM sales) x"
))
def _(s, d):
    days = T.sales(s, d).select("date").distinct()
    return X.add_event_distance(days, T.holidays(s, d)).withColumns({c: F.col(c).cast("long") for c in ("days_to_holiday", "days_since_holiday")})


@query("asof_keyed", (
    "SELECT o_orderkey AS o_orderkey, o_custkey AS k, CAST(o_orderdate AS DATE) AS date, (SELECT MIN(CAST(p.o_orderdate AS DATE)) FROM orders p "
    "WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F' AND CAST(p.o_orderdate AS DATE) > CAST(o.o_orderdate AS DATE)) AS next_event, "
    "(SELECT MAX(CAST(p.o_orderdate AS DATE)) FROM orders p "
    "WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'F' AND CAST(p.o_orderdate AS DATE) <= CAST(o.o_orderdate AS DATE)) AS prev_event "
    "FROM orders o"
), "", False)
def _(s, d):
    o = T.read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus")
    f = o.filter("o_orderstatus = 'F'")
    return X.asof_prev(X.asof_next(o.drop("o_orderstatus"), f, keys=["k"], exact=False), f, keys=["k"], exact=True)


@query("lags_by_row", (
    f"SELECT date, store_nbr, family, LAG(sales, 7) OVER w AS sales_lag_7, LAG(sales, 14) OVER w AS sales_lag_14, LAG(sales, "
    f"28) OVER w AS sales_lag_28, LAG(sales, 35) OVER w AS sales_lag_35, LAG(sales, 364) OVER w AS sales_lag_364, LAG(sales, "
    f"365) OVER w AS sales_lag_365 FROM sales WINDOW w AS {SERIES}"
), "sales_lag_7 sales_lag_14 sales_lag_28 sales_lag_35 sales_lag_364 sales_lag_365")
def _(s, d):
    return X.add_lags(T.sales(s, d)).drop("sales", "onpromotion")


@query("lags_by_date", (
    "SELECT s.date, s.store_nbr, s.family, a.sales AS sales_lag_7, b.sales AS sales_lag_14 FROM sales s LEFT "
    "JOIN sales a ON a.store_nbr = s.store_nbr AND a.family = s.family AND a.date = s.date - 7 LEFT "
    "JOIN sales b ON b.store_nbr = s.store_nbr AND b.family = s.family AND b.date = s.date - 14"
), "sales_lag_7 sales_lag_14")
def _(s, d):
    return X.add_lags(T.sales(s, d), lags=[7, 14], by="date").drop("sales", "onpromotion")


def _roll(n: int, lag: int) -> str:
    return f"(PARTITION BY store_nbr, family ORDER BY date ROWS BETWEEN {lag + n - 1} PRECEDING AND {lag} PRECEDING)"


ROLLS = ", ".join(f"AVG(sales) OVER {_roll(n, k)} AS sales_roll_mean_{n}_lag{k}, COALESCE(STDDEV_SAMP(sales) OVER {_roll(n, k)}, 0) AS sales_roll_std_{n}_lag{k}" for n, k in ((14, 7), (28, 7), (28, 14)))
ROLL_COLS = " ".join(f"sales_roll_{a}_{n}_lag{k}" for n, k in ((14, 7), (28, 7), (28, 14)) for a in ("mean", "std"))


@query("rolling_features", f"SELECT date, store_nbr, family, {ROLLS} FROM sales", ROLL_COLS)
def _(s, d):
    return X.add_rolling(T.sales(s, d)).drop("sales", "onpromotion")


@query("rolling_max", f"SELECT date, store_nbr, family, MAX(sales) OVER {_roll(14, 7)} AS sales_roll_max_14_lag7 FROM sales", "sales_roll_max_14_lag7")
def _(s, d):
    return X.add_rolling(T.sales(s, d), windows=[14], lags=[7], aggs=("max",)).drop("sales", "onpromotion")


@query("promo_counts", (
    "SELECT date, store_nbr, family, CAST(SUM(onpromotion) OVER (PARTITION BY store_nbr, family "
    "ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS BIGINT) AS promo_count_7d, CAST(SUM(onpromotion) OVER (PARTITION BY store_nbr, "
    "family ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS BIGINT) AS promo_count_14d FROM sales"
))
def _(s, d):
    return X.add_promo_counts(T.sales(s, d)).drop("sales", "onpromotion")


@query("price_features", (
    "SELECT date, AVG(oil_price) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS oil_7d_ma, "
    "AVG(oil_price) OVER (ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS oil_28d_ma, oil_price / LAG(oil_price, "
    "7) OVER (ORDER BY date) - 1 AS oil_pct_change_7d FROM oil_days"
), "oil_7d_ma oil_28d_ma oil_pct_change_7d")
def _(s, d):
    return X.price_features(P.oil_prices(T.oil(s, d)))


@query("traffic_features", (
    "SELECT date, store_nbr, LAG(transactions, 7) OVER w AS transactions_lag7, AVG(transactions) OVER (PARTITION BY store_nbr "
    "ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS transactions_roll7 FROM transactions WINDOW w AS (PARTITION BY store_nbr "
    "ORDER BY date)"
), "transactions_roll7")
def _(s, d):
    return X.traffic_features(T.transactions(s, d))


FEATURE_SQL = (
    f"SELECT m.date, m.store_nbr, m.family, m.onpromotion, m.oil_price, m.is_holiday, m.transactions, f.transactions_roll7, p.oil_7d_ma, "
    f"LAG(m.sales, 7) OVER {SERIES} AS sales_lag_7, AVG(m.sales) OVER {_roll(14, 7)} AS sales_roll_mean_14_lag7, "
    f"COALESCE(STDDEV_SAMP(m.sales) OVER {_roll(14, 7)}, 0) AS sales_roll_std_14_lag7, CAST(SUM(m.onpromotion) OVER (PARTITION BY store_nbr, "
    f"family ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS BIGINT) AS promo_count_7d FROM master m LEFT JOIN (SELECT date, "
    f"AVG(oil_price) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS oil_7d_ma FROM oil_days) p USING (date) LEFT "
    f"JOIN (SELECT date, store_nbr, AVG(transactions) OVER (PARTITION BY store_nbr "
    f"ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS transactions_roll7 FROM transactions) f USING (date, store_nbr)"
)
FEATURE_COLS = "oil_price transactions_roll7 oil_7d_ma sales_lag_7 sales_roll_mean_14_lag7 sales_roll_std_14_lag7"


def features(s, d) -> DataFrame:
    return X.build_features(T.master(s, d), T.holidays(s, d), P.oil_prices(T.oil(s, d)), T.transactions(s, d))


@query("build_features", FEATURE_SQL, FEATURE_COLS)
def _(s, d):
    return features(s, d).select("date", "store_nbr", "family", "onpromotion", "oil_price", "is_holiday", "transactions", "transactions_roll7", "oil_7d_ma", "sales_lag_7", "sales_roll_mean_14_lag7", "sales_roll_std_14_lag7", "promo_count_7d")


@query("drop_incomplete", (
    f"SELECT store_nbr, COUNT(*) AS n, SUM(sales_lag_7) AS lagged FROM ({FEATURE_SQL}) "
    f"WHERE sales_lag_7 IS NOT NULL AND sales_roll_mean_14_lag7 IS NOT NULL AND oil_7d_ma IS NOT NULL AND promo_count_7d IS NOT NULL GROUP BY 1"
), "lagged")
def _(s, d):
    full = X.drop_incomplete(features(s, d), ["sales_lag_7", "sales_roll_mean_14_lag7", "oil_7d_ma", "promo_count_7d"])
    return full.groupBy("store_nbr").agg(F.count("*").alias("n"), F.sum("sales_lag_7").alias("lagged"))


@query("feature_columns", (
    f"SELECT date, store_nbr, (SELECT COUNT(DISTINCT f.family) FROM sales f WHERE f.family < m.family) AS family_code, onpromotion, oil_price, "
    f"is_holiday, transactions FROM master m"
), "oil_price")
def _(s, d):
    m = X.add_codes(T.master(s, d), ["family"]).drop("cluster", "type")
    return m.select("date", *X.feature_columns(m)).withColumn("family_code", F.col("family_code").cast("long"))


FOLDS = (
    "folds AS (SELECT CAST(i AS INT) AS fold_id, a AS train_start, CAST(b - CAST(i AS INT) * 16 - 16 AS DATE) AS train_end, "
    "CAST(b - CAST(i AS INT) * 16 - 15 AS DATE) AS val_start, CAST(b - CAST(i AS INT) * 16 AS DATE) AS val_end FROM (SELECT MIN(date) AS a, "
    "MAX(date) AS b FROM sales), range(3) t(i) WHERE date_diff('day', a, b - CAST(i AS INT) * 16 - 16) >= 180)"
)


def _with_folds(q: str) -> str:
    return f"WITH {FOLDS} {q}"


@query("walk_forward_folds", _with_folds("SELECT * FROM folds"))
def _(s, d):
    return B.walk_forward_folds(T.sales(s, d))


@query("fold_assignment", _with_folds((
    "SELECT fold_id, CASE WHEN date BETWEEN val_start AND val_end THEN 'val' ELSE 'train' END AS role, COUNT(*) AS n, SUM(sales) AS sales "
    "FROM sales JOIN folds ON date BETWEEN val_start AND val_end OR date BETWEEN train_start AND train_end GROUP BY 1, 2"
)), "sales")
def _(s, d):
    x = T.sales(s, d)
    return B.assign_folds(x, B.walk_forward_folds(x)).groupBy("fold_id", "role").agg(F.count("*").alias("n"), F.sum("sales").alias("sales"))


@query("naive_backtest", _with_folds((
    f"SELECT fold_id, {R} AS rmsle, {W} AS wape, {BIAS} AS bias, COUNT(*) AS n_rows FROM predictions "
    f"JOIN folds ON date BETWEEN val_start AND val_end GROUP BY 1"
)), "rmsle wape bias")
def _(s, d):
    x = X.add_lags(T.sales(s, d), lags=[7])
    return B.naive_backtest(x, B.walk_forward_folds(x), "sales_lag_7")


@query("out_of_fold", _with_folds("SELECT fold_id, date, store_nbr, family, sales, predicted FROM predictions JOIN folds ON date BETWEEN val_start AND val_end"), "sales predicted")
def _(s, d):
    p = T.predictions(s, d)
    each = B.assign_folds(p, B.walk_forward_folds(p)).filter("role = 'val'").select("fold_id", "date", "store_nbr", "family", "sales", "predicted")
    return B.out_of_fold([each.filter(F.col("fold_id") == i) for i in range(3)])


@query("holdout_inclusive", "SELECT date >= (SELECT MAX(date) FROM sales) - 15 AS is_val, COUNT(*) AS n, COUNT(DISTINCT date) AS days FROM sales GROUP BY 1")
def _(s, d):
    return B.holdout(T.sales(s, d)).groupBy("is_val").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"))


@query("holdout_exclusive", "SELECT date > (SELECT MAX(date) FROM sales) - 15 AS is_val, COUNT(*) AS n, COUNT(DISTINCT date) AS days FROM sales GROUP BY 1")
def _(s, d):
    return B.holdout(T.sales(s, d), inclusive=False).groupBy("is_val").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"))


@query("evaluate_overall", f"SELECT {R} AS rmsle, {W} AS wape, {BIAS} AS bias, COUNT(*) AS n_rows FROM predictions", "rmsle wape bias")
def _(s, d):
    return M.evaluate(T.predictions(s, d))


for _dim in ("store_nbr", "holiday_type", "month"):
    _src = "predictions" if _dim != "month" else "(SELECT *, CAST(month(date) AS INT) AS month FROM predictions)"

    @query(f"error_by_{_dim}", f"SELECT {_dim}, {R} AS rmsle, {W} AS wape, COUNT(*) AS n_rows, AVG(sales) AS mean_sales, SUM(sales) AS total_sales FROM {_src} GROUP BY 1", "rmsle wape mean_sales total_sales")
    def _(s, d, dim=_dim):
        return M.error_by(T.predictions(s, d).withColumn("month", F.month("date")), dim)


@query("error_by_promotion", (
    f"SELECT CASE onpromotion WHEN 0 THEN 'not promoted' ELSE 'promoted' END AS promotion, {R} AS rmsle, {W} AS wape, COUNT(*) AS n_rows, "
    f"AVG(sales) AS mean_sales, SUM(sales) AS total_sales FROM predictions WHERE onpromotion IN (0, 1) GROUP BY 1"
), "rmsle wape mean_sales total_sales")
def _(s, d):
    return M.error_by_promotion(T.predictions(s, d))


def _slice(name: str, value: str, rest: str = "") -> str:
    return f"SELECT '{name}' AS slice, {value} AS value, {R} AS rmsle, {W} AS wape, {BIAS} AS bias, COUNT(*) AS n_rows FROM predictions {rest} GROUP BY 2"


@query("error_report", " UNION ALL ".join([_slice("overall", "'all'"), _slice("family", "family"), _slice("store", "CAST(store_nbr AS VARCHAR)"), _slice("promotion", "CASE onpromotion WHEN 0 THEN 'not promoted' ELSE 'promoted' END", "WHERE onpromotion IN (0, 1)"), _slice("holiday_type", "holiday_type")]), "rmsle wape bias")
def _(s, d):
    return M.error_report(T.predictions(s, d))


@query("worst_slices", (
    f"SELECT store_nbr, family, {R} AS rmsle, {W} AS wape, COUNT(*) AS n_rows FROM predictions GROUP BY 1, 2 ORDER BY ROUND({R}, 6) DESC, "
    f"store_nbr, family LIMIT 20"
), "rmsle wape")
def _(s, d):
    by = M.evaluate(T.predictions(s, d), ["store_nbr", "family"]).drop("bias")
    return by.orderBy(F.desc(F.round("rmsle", 6)), "store_nbr", "family").limit(20)


RN = RMSLE.format(p="naive", y="sales")


@query("forecast_value_added", f"SELECT family, {R} AS rmsle_model, {RN} AS rmsle_naive, 1 - {R} / NULLIF({RN}, 0) AS fva FROM predictions GROUP BY 1", "rmsle_model rmsle_naive fva")
def _(s, d):
    return M.forecast_value_added(T.predictions(s, d), by=["family"])


@query("inverse_rmsle_weights", f"SELECT (1 / {R}) / (1 / {R} + 1 / {RN}) AS w_predicted, (1 / {RN}) / (1 / {R} + 1 / {RN}) AS w_naive FROM predictions", "w_predicted w_naive")
def _(s, d):
    return M.inverse_rmsle_weights(T.predictions(s, d), "sales", ["predicted", "naive"])


@query("feature_medians", "SELECT MEDIAN(sales) AS sales, MEDIAN(onpromotion) AS onpromotion, MEDIAN(transactions) AS transactions, MEDIAN(oil_price) AS oil_price FROM master", "sales onpromotion transactions oil_price")
def _(s, d):
    return M.feature_medians(T.master(s, d), ["sales", "onpromotion", "transactions", "oil_price"])


@query("median_imputation", (
    f"WITH l AS (SELECT date, store_nbr, family, LAG(sales, 7) OVER {SERIES} AS sales_lag_7 FROM sales) SELECT date, store_nbr, family, "
    f"COALESCE(sales_lag_7, (SELECT MEDIAN(sales_lag_7) FROM l)) AS sales_lag_7 FROM l"
), "sales_lag_7")
def _(s, d):
    x = X.add_lags(T.sales(s, d).drop("onpromotion"), lags=[7]).drop("sales")
    return M.impute(x, M.feature_medians(x, ["sales_lag_7"]), ["sales_lag_7"])


@query("histogram_log_sales", (
    "WITH v AS (SELECT LN(1 + sales) AS v FROM sales), r AS (SELECT MIN(v) AS a, MAX(v) AS b FROM v) "
    "SELECT CAST(LEAST(FLOOR((v - a) / ((b - a) / 50)), 49) AS INT) AS bin, MIN(a) + LEAST(FLOOR((v - a) / ((b - a) / 50)), "
    "49) * MIN((b - a) / 50) AS lo, MIN(a) + (LEAST(FLOOR((v - a) / ((b - a) / 50)), 49) + 1) * MIN((b - a) / 50) AS hi, COUNT(*) AS n FROM v, r "
    "GROUP BY LEAST(FLOOR((v - a) / ((b - a) / 50)), 49)"
), "lo hi")
def _(s, d):
    return M.histogram(T.sales(s, d), F.log1p("sales"))


@query("daily_totals", "SELECT date, SUM(sales) AS total FROM sales GROUP BY 1", "total")
def _(s, d):
    return M.daily_totals(T.sales(s, d))


@query("mean_by_weekday", "SELECT CAST(isodow(date) - 1 AS INT) AS day_of_week, AVG(sales) AS mean, COUNT(*) AS n FROM sales GROUP BY 1", "mean")
def _(s, d):
    return M.mean_by(T.sales(s, d), F.weekday("date").alias("day_of_week"))


@query("mean_by_holiday", "SELECT is_holiday, AVG(sales) AS mean, COUNT(*) AS n FROM master GROUP BY 1", "mean")
def _(s, d):
    return M.mean_by(T.master(s, d), "is_holiday")


@query("mean_by_promotion", "SELECT onpromotion > 0 AS promoted, AVG(sales) AS mean, COUNT(*) AS n FROM sales GROUP BY 1", "mean")
def _(s, d):
    return M.mean_by(T.sales(s, d), (F.col("onpromotion") > 0).alias("promoted"))


@query("top_families", "SELECT family, SUM(sales) AS total FROM sales GROUP BY 1 ORDER BY total DESC, family LIMIT 15", "total")
def _(s, d):
    return M.top_totals(T.sales(s, d), "family")


@query("summarize_predictions", (
    "SELECT COUNT(predicted) AS n, COUNT(*) FILTER (predicted = 0) AS zeros, AVG(predicted) AS mean, STDDEV_SAMP(predicted) AS std, "
    "MIN(predicted) AS min, quantile_cont(predicted, 0.25) AS p25, quantile_cont(predicted, 0.5) AS p50, quantile_cont(predicted, 0.75) AS p75, "
    "MAX(predicted) AS max FROM predictions"
), "mean std min p25 p50 p75 max")
def _(s, d):
    return M.summarize(T.predictions(s, d), "predicted")


@query("log_target", "SELECT store_nbr, SUM(LN(1 + GREATEST(sales, 0))) AS logged, SUM(EXP(LN(1 + GREATEST(sales, 0))) - 1) AS back FROM sales GROUP BY 1", "logged back")
def _(s, d):
    y = F.log1p(M.clip0(F.col("sales")))
    return T.sales(s, d).groupBy("store_nbr").agg(F.sum(y).alias("logged"), F.sum(F.expm1(y)).alias("back"))


@query("clip_and_blend", (
    "SELECT date, store_nbr, family, GREATEST(0.6 * (predicted - 20) + 0.4 * (naive - 30), 0) AS after, 0.5 * GREATEST(predicted - 20, "
    "0) + 0.5 * GREATEST(naive - 30, 0) AS members FROM predictions"
), "after members")
def _(s, d):
    p = T.predictions(s, d).withColumns({"a": F.col("predicted") - 20, "b": F.col("naive") - 30})
    return p.select("date", "store_nbr", "family", B.blend(["a", "b"], [0.6, 0.4]).alias("after"), B.blend(["a", "b"], clip="members").alias("members"))


@query("align_to_template", (
    "SELECT t.id, COALESCE(p.predicted, 0) AS sales FROM (SELECT concat(CAST(date AS VARCHAR), '_', store_nbr, '_', family) AS id FROM sales) t "
    "LEFT JOIN (SELECT concat(CAST(date AS VARCHAR), '_', store_nbr, '_', family) AS id, predicted FROM predictions WHERE predicted > 0) p "
    "USING (id)"
), "sales")
def _(s, d):
    named = T.predictions(s, d).withColumn("id", F.concat_ws("_", F.col("date").cast("string"), "store_nbr", "family"))
    return B.align_to_template(named, named.filter("predicted > 0"), "predicted")
