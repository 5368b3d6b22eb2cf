"""Forecast error measures as Column expressions, usable in any aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def clip0(x: Column) -> Column:
    """max(x, 0); null stays null (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def rmsle(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(F.log1p(clip0(p)) - F.log1p(clip0(y)), 2)))


def wape(y: Column, p: Column) -> Column:
    """Sum of |y - p| over the sum of |y| + 1e-8; the epsilon is added in every row."""
    return F.sum(F.abs(y - p)) / F.sum(F.abs(y) + F.lit(1e-8))


def bias(y: Column, p: Column) -> Column:
    return F.avg(p - y)


def evaluate(df: DataFrame, by: list[str] = (), y: str = "sales", p: str = "predicted") -> DataFrame:
    """All measures, overall or per value of ``by``, in one aggregation."""
    yc, pc = F.col(y), F.col(p)
    return df.groupBy(*by).agg(rmsle(yc, pc).alias("rmsle"), wape(yc, pc).alias("wape"), bias(yc, pc).alias("bias"), F.count("*").alias("n_rows"))


def error_by(df: DataFrame, dim: str, y: str = "sales", p: str = "predicted") -> DataFrame:
    """Error slice by a dimension, worst first; ties by the dimension."""
    yc, pc = F.col(y), F.col(p)
    out = df.groupBy(dim).agg(rmsle(yc, pc).alias("rmsle"), wape(yc, pc).alias("wape"), F.count("*").alias("n_rows"), F.avg(yc).alias("mean_sales"), F.sum(yc).alias("total_sales"))
    return out.orderBy(F.desc("rmsle"), dim)


def error_by_promotion(df: DataFrame, y: str = "sales", p: str = "predicted") -> DataFrame:
    """Error of rows without and with exactly one promoted item; other rows are left out."""
    label = F.when(F.col("onpromotion") == 0, "not promoted").otherwise("promoted")
    return error_by(df.filter(F.col("onpromotion").isin(0, 1)).withColumn("promotion", label), "promotion", y, p)


def error_report(df: DataFrame, y: str = "sales", p: str = "predicted") -> DataFrame:
    """Overall error and the slices by family, store, promotion and event type in one pass with grouping sets.

    ``slice`` names the set, ``value`` its key. Promotion has the two labels of ``error_by_promotion``.
    """
    yc, pc = F.col(y), F.col(p)
    promo = F.when(F.col("onpromotion") == 0, "not promoted").when(F.col("onpromotion") == 1, "promoted")
    base = df.withColumn("promotion", promo).withColumn("store", F.col("store_nbr").cast("string"))
    sets = [[], [F.col("family")], [F.col("store")], [F.col("promotion")], [F.col("holiday_type")]]
    keys = ["family", "store", "promotion", "holiday_type"]
    out = base.groupingSets(sets, *keys).agg(F.grouping_id(*keys).alias("g"), rmsle(yc, pc).alias("rmsle"), wape(yc, pc).alias("wape"), bias(yc, pc).alias("bias"), F.count("*").alias("n_rows"))
    name = F.when(F.col("g") == 15, "overall").when(F.col("g") == 7, "family").when(F.col("g") == 11, "store").when(F.col("g") == 13, "promotion").otherwise("holiday_type")
    value = F.when(F.col("g") == 15, "all").otherwise(F.coalesce("family", "store", "promotion", "holiday_type"))
    return out.select(name.alias("slice"), value.alias("value"), "rmsle", "wape", "bias", "n_rows").filter("value is not null")


def forecast_value_added(df: DataFrame, y: str = "sales", model: str = "predicted", naive: str = "naive", by: list[str] = ()) -> DataFrame:
    """1 - RMSLE of the model over RMSLE of the naive forecast."""
    m, n = rmsle(F.col(y), F.col(model)), rmsle(F.col(y), F.col(naive))
    return df.groupBy(*by).agg(m.alias("rmsle_model"), n.alias("rmsle_naive"), (1 - m / F.nullif(n, F.lit(0.0))).alias("fva"))


def inverse_rmsle_weights(df: DataFrame, y: str, models: list[str]) -> DataFrame:
    """Blend weights in proportion to 1 / RMSLE of each model, one row."""
    inv = {m: 1 / rmsle(F.col(y), F.col(m)) for m in models}
    total = sum(inv.values())
    return df.agg(*[(w / total).alias(f"w_{m}") for m, w in inv.items()])


def feature_medians(df: DataFrame, cols: list[str], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """One row with the median of each column over non-null values, exact by selection over the cluster, or from a sketch."""
    if exact:
        return exact_quantiles(df, cols, [0.5]).groupBy().agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in cols])
    return df.agg(*[F.percentile_approx(c, 0.5, accuracy).cast("double").alias(c) for c in cols])


def impute(df: DataFrame, medians: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls of ``cols`` filled from the one-row table of medians."""
    row = F.broadcast(medians.select(*[F.col(c).alias(f"_m_{c}") for c in cols]))
    return df.crossJoin(row).select(*[F.coalesce(F.col(c).cast("double"), f"_m_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, n) of equal bins over [min, max]; the last bin is closed. Empty bins are left out."""
    v = df.select(value.cast("double").alias("v")).filter("v is not null")
    span = v.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") == F.col("a"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1))).cast("int")
    return v.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg((F.min("a") + F.col("bin") * F.min(width)).alias("lo"), (F.min("a") + (F.col("bin") + 1) * F.min(width)).alias("hi"), F.count("*").alias("n"))


def summarize(df: DataFrame, col: str) -> DataFrame:
    """Count, zeros, mean, deviation, extremes and quartiles of a column, one row."""
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    q = exact_quantiles(df, [col], list(probs.values())).groupBy().agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in probs.items()])
    out = df.agg(F.count(col).alias("n"), F.count_if(F.col(col) == 0).alias("zeros"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    return out.crossJoin(F.broadcast(q)).select("n", "zeros", "mean", "std", "min", *probs, "max")  # one row each


def daily_totals(df: DataFrame, value: str = "sales", date: str = "date") -> DataFrame:
    return df.groupBy(date).agg(F.sum(value).alias("total"))


def mean_by(df: DataFrame, key: str | Column, value: str = "sales") -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def top_totals(df: DataFrame, key: str, value: str = "sales", n: int = 15) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key).limit(n)
