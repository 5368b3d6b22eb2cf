"""From the raw sales tables to one master panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans

#: Rows of a dimension up to which it is sent to every executor. Stores, days and events stay far below.
DIMENSION_ROWS = 1_000_000


def small(df: DataFrame, rows: int = DIMENSION_ROWS) -> DataFrame:
    """``df`` with a hint to broadcast it if it has at most so many rows; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@dataclass
class SalesTables:
    train: DataFrame
    test: DataFrame
    stores: DataFrame
    oil: DataFrame
    holidays: DataFrame
    transactions: DataFrame


def ffill_bfill(df: DataFrame, col: str, order: str, keys: list[str] = (), rows: int = DIMENSION_ROWS) -> DataFrame:
    """Nulls of ``col`` take the last value before them, at the beginning the first after.

    Without keys, more than ``rows`` rows are filled over ranges of ``order``, each range's last value handed to the next.
    """
    if not keys and df.limit(rows + 1).count() > rows:
        dealt = scans.dealt(df, [], [order])
        filled = scans.scan(scans.scan(dealt, [], {"_before": ("last", col)}), [], {"_after": ("last", col)}, ahead=True)
        return filled.withColumn(col, F.coalesce("_before", "_after")).drop(scans.AT, "_before", "_after")
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(col, F.coalesce(F.last(col, True).over(back), F.first(col, True).over(ahead)))


def daily_spine(df: DataFrame, date: str = "date", keys: list[str] = ()) -> DataFrame:
    """Every day between the first and last (per key), left-joined with ``df``."""
    span = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date))
    return days.join(df, [*keys, date], "left")


def oil_prices(oil: DataFrame, price: str = "dcoilwtico", flag: bool = False) -> DataFrame:
    """(date, oil_price) for every day of the span, gaps filled; ``flag`` adds oil_imputed."""
    spine = daily_spine(oil.select("date", price)).withColumnRenamed(price, "oil_price")
    if flag:
        spine = spine.withColumn("oil_imputed", F.col("oil_price").isNull().cast("int"))
    return ffill_bfill(spine, "oil_price", "date")


def resample_daily_last(df: DataFrame, value: str, ts: str) -> DataFrame:
    """(date, value): the last value of each day, days without one filled from before."""
    daily = df.groupBy(F.col(ts).cast("date").alias("date")).agg(F.max_by(value, ts).alias(value))
    return ffill_bfill(daily_spine(daily), value, "date")


def collapse_holidays(holidays: DataFrame, mode: str = "first") -> DataFrame:
    """One row per date. ``first``: type and locale of the first row that has them; ``priority``: national before regional before local.

    A transferred day still counts as an event.
    """
    rank = F.when(F.col("locale") == "National", 0).when(F.col("locale") == "Regional", 1).otherwise(2) if mode == "priority" else F.lit(0)
    order = F.struct(rank, F.col("row_id"))
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    return holidays.groupBy("date").agg(pick("type").alias("holiday_type"), pick("locale").alias("holiday_locale"), F.max(F.coalesce(F.col("transferred"), F.lit(False))).alias("transferred"), F.max(F.coalesce(F.col("locale") == "National", F.lit(False))).alias("is_national"), F.lit(1).alias("is_holiday"))


def fill_holiday_defaults(df: DataFrame) -> DataFrame:
    """Flags of days without an event are 0, its names are "None"."""
    flags = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("is_holiday", "transferred", "is_national")}
    names = {c: F.coalesce(F.col(c), F.lit("None")) for c in ("holiday_type", "holiday_locale")}
    return df.withColumns(flags | names)


def build_master(t: SalesTables, holidays_mode: str = "first") -> tuple[DataFrame, DataFrame]:
    """Train and test, each left-joined with stores, oil, events and traffic.

    Stores, oil and events are dimensions (a row a store or day) and are broadcast up to DIMENSION_ROWS; traffic has a row a store and
    day, and is left to the optimizer, which broadcasts it while it is small and else shuffles by (date, store).
    """
    stores, oil, events = small(t.stores), small(oil_prices(t.oil)), small(collapse_holidays(t.holidays, holidays_mode))

    def merge(df: DataFrame) -> DataFrame:
        wide = df.join(stores, "store_nbr", "left").join(oil, "date", "left").join(events, "date", "left")
        return fill_holiday_defaults(wide.join(t.transactions, ["date", "store_nbr"], "left"))

    return merge(t.train), merge(t.test)


def one_timeline(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test in one table with is_test; test has no sales yet."""
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)), allowMissingColumns=True)


def split_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(~F.col("is_test")), df.filter("is_test")


def series_view(df: DataFrame, store: int, family: str) -> DataFrame:
    """One series in date order, actual beside predicted."""
    return df.filter((F.col("store_nbr") == store) & (F.col("family") == family)).select("date", "sales", "predicted").orderBy("date")
