"""Operators over frames in time order, in batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def most_common(labels: Column) -> Column:
    """The most common element of an array, of equals the one that comes first; "" for an empty array."""
    best = F.array_max(F.transform(F.array_distinct(labels), lambda v: F.struct(F.size(F.filter(labels, lambda x: x == v)).alias("n"), (-F.array_position(labels, v)).alias("p"), v.alias("v"))))
    return F.coalesce(best["v"], F.lit(""))


def smooth_labels(df: DataFrame, window: int = 3, key: str = "stream_id", order: list[str] = ("ts",), label: str = "class_name") -> DataFrame:
    """``df`` with smoothed: the most common label of the last ``window`` frames of its stream. Frames without a label take a place but no vote."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0)
    rows = df.withColumn("_h", F.collect_list(label).over(w))
    return rows.withColumn("smoothed", most_common(F.col("_h"))).drop("_h")


def frame_rate(df: DataFrame, every: str = "500 milliseconds", key: str = "stream_id", ts: str = "ts") -> DataFrame:
    """(stream, start, n, fps) of tumbling windows."""
    seconds = pd.Timedelta(every).total_seconds()
    return df.groupBy(key, F.window(ts, every)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n", (F.col("n") / seconds).alias("fps"))


def debounce(df: DataFrame, key: str = "stream_id", ts: str = "ts", order: str = "event_id", min_gap: float = 0.1) -> DataFrame:
    """Rows at least ``min_gap`` seconds after the last kept row of their key.

    What is kept depends on what was, so a key's rows pass in order; they come sorted from the shuffle in batches, and only the time
    of the last kept row goes from one batch to the next.
    """
    gap = round(min_gap * 1e6)

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0
        for pdf in frames:
            mask = []
            for k, t in zip(pdf[key].tolist(), (pdf[ts].astype("int64") // _micro(pdf[ts])).tolist(), strict=True):
                ok = now is None or k != now[0] or t - last >= gap
                now, last = (k,), t if ok else last
                mask.append(ok)
            yield pdf[mask]

    return df.repartition(key).sortWithinPartitions(key, ts, order).mapInPandas(keep, df.schema)


def _micro(times: pd.Series) -> int:
    """How many of the column's units are a microsecond."""
    return {"ns": 1000, "us": 1}[times.dt.unit]


def capture_progress(df: DataFrame, target: int, cls: str = "class_name") -> DataFrame:
    """(class, captured, share): how much of the target each class has."""
    return df.groupBy(cls).agg(F.count("*").alias("captured")).withColumn("share", F.least(F.col("captured") / target, F.lit(1.0)))
