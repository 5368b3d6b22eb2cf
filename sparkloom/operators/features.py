"""Leakage-safe features of a sales panel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .panel import small

SERIES = ["store_nbr", "family"]
LAGS = [7, 14, 28, 35, 364, 365]
#: Codes of event types. Fixed values.
EVENT_CODES = {"None": 0, "Holiday": 1, "Transfer": 2, "Bridge": 3, "Additional": 4, "Event": 5, "Work Day": 6}
CATEGORIES = ["family", "city", "state", "type", "holiday_type", "holiday_locale"]
#: Model inputs in their order. Fixed values.
FEATURES = [
    "store_nbr", "family", "onpromotion",
    "day_of_week", "day_of_month", "month", "year", "week_of_year", "quarter", "is_weekend", "is_month_start", "is_month_end", "day_of_year",
    "dow_sin", "dow_cos", "month_sin", "month_cos",
    "cluster", "type",
    "oil_price", "oil_7d_ma", "oil_28d_ma", "oil_pct_change_7d",
    "is_holiday", "holiday_type_enc", "is_national_holiday", "is_transferred", "days_to_holiday", "days_since_holiday",
    "promo_count_7d", "promo_count_14d",
    "transactions", "transactions_lag7", "transactions_roll7",
    "sales_lag_7", "sales_lag_14", "sales_lag_28", "sales_lag_35", "sales_lag_364", "sales_lag_365",
    "sales_roll_mean_14_lag7", "sales_roll_mean_28_lag7", "sales_roll_std_14_lag7", "sales_roll_mean_28_lag14",
]


#: A series' rows in pieces, and the mark of those rows of a piece that stand before it.
_PIECE, _HALO = "_piece", "_halo"


def series_window(df: DataFrame) -> Window:
    """The one window of all series features of ``df``: one exchange and one sort serve them all. Pieces of series are windows of their own."""
    return Window.partitionBy(*SERIES, *[c for c in (_PIECE,) if c in df.columns]).orderBy("date")


def split_series(df: DataFrame, rows: int = 65_536, reach: int = max(LAGS)) -> DataFrame:
    """Series in pieces of so many rows, each with the ``reach`` rows before it, so that row frames that reach no further back stay exact.

    For series that are too long, or hold too much of the table, for one task. Rows are numbered by a scan over ranges of series and
    date. ``join_series`` drops the rows before the pieces again.
    """
    if reach >= rows:
        raise ValueError("a piece must hold more rows than a frame reaches back")
    numbered = scans.scan(scans.dealt(df, SERIES, ["date"]), SERIES, {"_n": ("sum", F.lit(1))}).drop(scans.AT)
    at = F.col("_n") - 1
    piece = F.floor(at / rows)
    own, next_one = F.struct(piece.alias("p"), F.lit(False).alias("h")), F.struct((piece + 1).alias("p"), F.lit(True).alias("h"))
    into = F.explode(F.when(at % rows >= rows - reach, F.array(own, next_one)).otherwise(F.array(own)))
    return numbered.withColumn("_into", into).withColumns({_PIECE: F.col("_into.p"), _HALO: F.col("_into.h")}).drop("_n", "_into")


def join_series(df: DataFrame) -> DataFrame:
    """The rows of ``split_series``, each once."""
    return df.filter(~F.col(_HALO)).drop(_PIECE, _HALO)


def add_calendar(df: DataFrame) -> DataFrame:
    d = F.col("date")
    df = df.withColumns({
        "day_of_week": F.weekday(d), "day_of_month": F.dayofmonth(d), "month": F.month(d), "year": F.year(d), "week_of_year": F.weekofyear(d),
        "quarter": F.quarter(d), "day_of_year": F.dayofyear(d), "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "is_month_start": (d == F.trunc(d, "MM")).cast("int"), "is_month_end": (d == F.last_day(d)).cast("int"),
    })
    day, month = 2 * math.pi / 7 * F.col("day_of_week"), 2 * math.pi / 12 * F.col("month")
    return df.withColumns({"dow_sin": F.sin(day), "dow_cos": F.cos(day), "month_sin": F.sin(month), "month_cos": F.cos(month)})


def add_event_codes(df: DataFrame) -> DataFrame:
    code = F.create_map(*[F.lit(x) for kv in EVENT_CODES.items() for x in kv])
    return df.withColumns({"holiday_type_enc": F.coalesce(code[F.col("holiday_type")], F.lit(0)), "is_national_holiday": F.col("is_national"), "is_transferred": F.col("transferred")})


def asof_next(left: DataFrame, events: DataFrame, on: str = "date", keys: list[str] = (), name: str = "next_event", exact: bool = True, ranges: bool = False) -> DataFrame:
    """The first event at or after (``exact=False``: after) each row's ``on``, per key.

    Distinct times of both sides are unioned and filled in one ordered pass, then joined back by equality: no range join. With
    ``ranges`` the pass is a scan over ranges of key and time, for few or no keys with many times; else a window per key.
    """
    return _asof(left, events, on, keys, name, exact, True, ranges)


def asof_prev(left: DataFrame, events: DataFrame, on: str = "date", keys: list[str] = (), name: str = "prev_event", exact: bool = False, ranges: bool = False) -> DataFrame:
    """The last event before (``exact=True``: at or before) each row's ``on``, per key."""
    return _asof(left, events, on, keys, name, exact, False, ranges)


def _asof(left: DataFrame, events: DataFrame, on: str, keys: list[str], name: str, exact: bool, ahead: bool, ranges: bool) -> DataFrame:
    keys = list(keys)
    times = left.select(*keys, on).distinct().withColumn("_e", F.lit(None).cast(events.schema[on].dataType))
    marks = events.select(*keys, F.col(on)).distinct().withColumn("_e", F.col(on))
    w = Window.partitionBy(*keys).orderBy(on)
    both = times.unionByName(marks).groupBy(*keys, on).agg(F.max("_e").alias("_e"))
    if ranges:
        filled = scans.scan(scans.dealt(both, keys, [on]), keys, {name: ("last", "_e")}, ahead=ahead, exclusive=not exact)
        return left.join(filled.select(*keys, on, name), [*keys, on], "left")
    if ahead:
        found = F.first("_e", True).over(w.rowsBetween(0 if exact else 1, Window.unboundedFollowing))
    else:
        found = F.last("_e", True).over(w.rowsBetween(Window.unboundedPreceding, 0 if exact else -1))
    filled = both.select(*keys, on, found.alias(name))
    return left.join(filled, [*keys, on], "left")


def add_event_distance(df: DataFrame, events: DataFrame, cap: int = 30, panel_only: bool = False) -> DataFrame:
    """days_to_holiday (0 on the day itself) and days_since_holiday (to the event before), capped; none counts as the cap.

    ``events`` has a date column. Distances are worked out on the distinct dates and broadcast back. ``panel_only`` uses only events on
    dates of the panel.
    """
    dates = df.select("date").distinct()
    own = events.select("date").distinct()
    if panel_only:
        own = own.join(dates, "date", "left_semi")
    near = asof_prev(asof_next(dates, own), own)
    far = lambda a, b: F.least(F.coalesce(F.datediff(a, b), F.lit(99)), F.lit(cap))
    known = near.select("date", far("next_event", "date").alias("days_to_holiday"), far("date", "prev_event").alias("days_since_holiday"))
    return df.join(F.broadcast(known), "date", "left")


def price_features(price: DataFrame) -> DataFrame:
    """(date, oil_7d_ma, oil_28d_ma, oil_pct_change_7d) at the grain of days from (date, oil_price): one small task."""
    w = Window.orderBy("date")
    before = lambda n: F.avg("oil_price").over(w.rowsBetween(-n, -1))
    return price.select("date", before(7).alias("oil_7d_ma"), before(28).alias("oil_28d_ma"), (F.col("oil_price") / F.lag("oil_price", 7).over(w) - 1).alias("oil_pct_change_7d"))


def traffic_features(tx: DataFrame) -> DataFrame:
    """(date, store_nbr, transactions_lag7, transactions_roll7) at the grain of store and day."""
    w = Window.partitionBy("store_nbr").orderBy("date")
    return tx.select("date", "store_nbr", F.lag("transactions", 7).over(w).alias("transactions_lag7"), F.avg("transactions").over(w.rowsBetween(-7, -1)).alias("transactions_roll7"))


def add_promo_counts(df: DataFrame, windows: list[int] = (7, 14)) -> DataFrame:
    w = series_window(df)
    return df.withColumns({f"promo_count_{n}d": F.sum("onpromotion").over(w.rowsBetween(-n, -1)) for n in windows})


def add_lags(df: DataFrame, target: str = "sales", lags: list[int] = LAGS, by: str = "row") -> DataFrame:
    """``row``: the value so many rows back in the series; ``date``: so many days back, null where that day is missing."""
    if by == "row":
        w = series_window(df)
        return df.withColumns({f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags})
    for k in lags:
        then = df.select(*SERIES, F.date_add("date", k).alias("date"), F.col(target).alias(f"{target}_lag_{k}"))
        df = df.join(then, [*SERIES, "date"], "left")
    return df


def add_rolling(df: DataFrame, target: str = "sales", windows: list[int] = (14, 28), lags: list[int] = (7, 14), aggs: tuple[str, ...] = ("mean", "std")) -> DataFrame:
    """Mean and sample deviation (and max, if asked for) of the ``window`` rows that end ``lag`` rows back, for windows above the lag.

    Shift and roll are one frame. A deviation of fewer than two values is 0.
    """
    w = series_window(df)
    new = {}
    for n in windows:
        for lag in lags:
            if n > lag:
                frame = w.rowsBetween(-(lag + n - 1), -lag)
                made = {"mean": F.avg(target), "std": F.stddev_samp(target), "max": F.max(target)}
                for a in aggs:
                    x = made[a].over(frame)
                    new[f"{target}_roll_{a}_{n}_lag{lag}"] = F.coalesce(x, F.lit(0.0)) if a == "std" else x
    return df.withColumns(new)


def ordinal_codes(df: DataFrame, col: str) -> DataFrame:
    """(col, col_code): place among the sorted distinct values."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().withColumn(f"{col}_code", F.dense_rank().over(Window.orderBy(col)) - 1)


def add_codes(df: DataFrame, cols: list[str] = CATEGORIES) -> DataFrame:
    """``<col>_code`` for each category column that ``df`` has; null is -1.

    One pass gathers the distinct values of all columns; categories are few, and their sorted values are broadcast as one row.
    For keys with many values use ``ordinal_codes`` and a join.
    """
    cols = [c for c in cols if c in df.columns]
    kinds = F.broadcast(df.agg(*[F.array_sort(F.collect_set(c)).alias(f"_{c}") for c in cols]))
    code = lambda c: F.coalesce(F.array_position(f"_{c}", F.col(c)) - 1, F.lit(-1)).cast("int")
    return df.crossJoin(kinds).withColumns({f"{c}_code": code(c) for c in cols}).drop(*[f"_{c}" for c in cols])


def build_features(df: DataFrame, events: DataFrame, price: DataFrame, tx: DataFrame, with_target: bool = True, piece_rows: int | None = None) -> DataFrame:
    """All features of a master panel. Row-local and day-grain steps don't shuffle the panel; series steps share one exchange.

    With ``piece_rows`` series are split into pieces of so many rows (see ``split_series``).
    """
    df = add_event_distance(add_event_codes(add_calendar(add_codes(df))), events)
    df = df.join(small(price_features(price)), "date", "left").join(traffic_features(tx), ["date", "store_nbr"], "left")
    if piece_rows:
        df = split_series(df, piece_rows)
    df = add_promo_counts(df)
    if with_target:
        df = add_rolling(add_lags(df))
    return drop_model_extras(join_series(df) if piece_rows else df)


def drop_model_extras(df: DataFrame) -> DataFrame:
    return df.drop("holiday_locale", "city", "state")


def feature_columns(df: DataFrame) -> list[str]:
    """The model inputs that ``df`` has; a category stands by its code."""
    return [f"{c}_code" if f"{c}_code" in df.columns else c for c in FEATURES if c in df.columns]


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)
