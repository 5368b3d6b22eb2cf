"""Walk-forward folds, naive forecasts and blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import clip0, evaluate


def walk_forward_folds(df: DataFrame, n: int = 3, horizon: int = 16, min_train: int = 180, date: str = "date") -> DataFrame:
    """(fold_id, train_start, train_end, val_start, val_end): fold i ends i horizons before the last date; short trainings are left out."""
    span = df.agg(F.min(date).alias("train_start"), F.max(date).alias("_last"))
    ids = df.sparkSession.range(n, numPartitions=1).select(F.col("id").cast("int").alias("fold_id"))
    end = F.date_sub("_last", F.col("fold_id") * horizon)
    folds = span.crossJoin(F.broadcast(ids)).select("fold_id", "train_start", F.date_sub(end, horizon).alias("train_end"), F.date_sub(end, horizon - 1).alias("val_start"), end.alias("val_end"))
    return folds.filter(F.datediff("train_end", "train_start") >= min_train)


def assign_folds(df: DataFrame, folds: DataFrame, date: str = "date") -> DataFrame:
    """Each row once for every fold it belongs to, with fold_id and role (train or val). Folds are a handful of rows and broadcast."""
    d = F.col(date)
    val, train = d.between(F.col("val_start"), F.col("val_end")), d.between(F.col("train_start"), F.col("train_end"))
    return df.join(F.broadcast(folds), val | train).withColumn("role", F.when(val, "val").otherwise("train")).drop("train_start", "train_end", "val_start", "val_end")


def holdout(df: DataFrame, days: int = 16, inclusive: bool = True, date: str = "date") -> DataFrame:
    """Rows with is_val: the last ``days`` days (``inclusive``: from last - (days - 1) on; else after it, one day less)."""
    last = F.broadcast(df.agg(F.max(date).alias("_last")))
    edge = F.date_sub("_last", days - 1)
    return df.crossJoin(last).withColumn("is_val", F.col(date) >= edge if inclusive else F.col(date) > edge).drop("_last")


def seasonal_naive(lag: str = "sales_lag_365") -> Column:
    """The value one season back; 0 where there is none; never negative."""
    return F.greatest(F.coalesce(F.col(lag), F.lit(0.0)), F.lit(0.0))


def naive_backtest(df: DataFrame, folds: DataFrame, lag: str = "sales_lag_365") -> DataFrame:
    """Error of the seasonal naive forecast per fold."""
    val = assign_folds(df, folds).filter("role = 'val'").withColumn("predicted", seasonal_naive(lag))
    return evaluate(val, ["fold_id"])


def blend(columns: list[str], weights: list[float] | None = None, clip: str = "after") -> Column:
    """Weighted sum of predictions, equal weights by default. ``after``: clipped at 0 as a whole; ``members``: each one before."""
    weights = weights or [1 / len(columns)] * len(columns)
    total = sum((w * (clip0(F.col(c)) if clip == "members" else F.col(c)) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    return clip0(total) if clip == "after" else total


def align_to_template(template: DataFrame, predictions: DataFrame, col: str = "sales") -> DataFrame:
    """(id, sales) of the template's ids; ids without a prediction are 0."""
    return template.select("id").join(predictions.select("id", F.col(col).alias("_p")), "id", "left").select("id", F.coalesce("_p", F.lit(0.0)).alias("sales"))


def out_of_fold(parts: list[DataFrame]) -> DataFrame:
    """Validation rows of all folds in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
