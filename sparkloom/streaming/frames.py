"""The frame operators over streams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.frames import capture_progress  # noqa: F401  the same plan over a stream, in update mode
from ..session import ship

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_APPEND = 4096

#: (what is carried, a row) to (what is carried then, the row to put out or None). Rows begin with microseconds and the order's value,
#: what is carried begins with microseconds.
Step = Callable[[tuple | None, tuple], tuple[tuple, tuple | None]]


def _ms(us: int) -> int:
    """The first millisecond at or after ``us``."""
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """A key's rows wait in state until the watermark has passed them; then they go through ``step`` in order of time.

    One timer a key stands at its earliest waiting row, or, if none waits, at the time after which what is carried no longer matters.
    """

    def __init__(self, rows: str, carried: str, names: list[str], step: Step, forget: int | None) -> None:
        self._rows, self._kept, self._step, self._forget = rows, carried, step, forget
        self._out = Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self._rows)
        self._carried = handle.getValueState("carried", self._kept)
        self._alarm = handle.getValueState("alarm", "ms long")

    def _wake(self, ms: int) -> None:
        self._handle.registerTimer(ms)
        self._alarm.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = None
        # the key comes first, the time that bears the watermark last
        for part in batched((tuple(r)[1:-1] for r in rows), _APPEND):
            self._waiting.appendList(list(part))
            low = min(r[0] for r in part)
            first = low if first is None else min(first, low)
        alarm = self._alarm.get()
        if first is not None and (alarm is None or _ms(first) < alarm[0]):
            if alarm is not None:
                self._handle.deleteTimer(alarm[0])
            self._wake(_ms(first))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], []
        for r in self._waiting.get():
            (ready if r[0] <= mark else rest).append(tuple(r))
        carried = self._carried.get()
        carried = None if carried is None else tuple(carried)
        for row in sorted(ready, key=_place):
            carried, out = _advance(self._step, self._forget, carried, row)
            if out is not None:
                yield self._out(*key, *out)
        if ready and rest:
            self._waiting.put(rest)
        elif ready:
            self._waiting.clear()
        stale = carried is not None and self._forget is not None and mark > carried[0] + self._forget
        if stale and not rest:
            self._carried.clear()
        elif ready:
            self._carried.update(carried)
        # the timer that has fired is Spark's to remove
        if rest:
            self._wake(_ms(min(r[0] for r in rest)))
        elif carried is not None and self._forget is not None and not stale:
            self._wake(_ms(carried[0] + self._forget) + 1)
        else:
            self._alarm.clear()

    def close(self) -> None:
        pass


def _place(row: tuple) -> tuple:
    """Time and order of a row, rows without an order first."""
    return row[0], row[1] is not None, row[1]


def _advance(step: Step, forget: int | None, carried: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
    """One step; what is carried from longer ago than ``forget`` counts as nothing."""
    if carried is not None and forget is not None and row[0] - carried[0] > forget:
        carried = None
    return step(carried, row)


@dataclass(frozen=True)
class Ordered:
    """An operator whose result depends on the order of a key's rows, for streams whose rows come out of order by up to ``delay``.

    ``rows``, ``carried`` and ``out`` are schemas (the key apart) whose first column is ``us``, microseconds; ``out`` gives it back as
    the time column. Rows without a time are left out, and Spark drops rows later than the watermark, as it does for windows. A key's
    state is its rows within the delay and what the step carries; a key whose next row comes over ``forget`` microseconds later starts
    afresh, None: never.
    """

    key: str
    ts: str
    rows: str
    carried: str
    out: str
    step: Step
    forget: int | None = None
    delay: str = "10 minutes"

    def _columns(self) -> list[str]:
        return StructType.fromDDL(self.rows).names[1:]

    def _named(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.timestamp_micros("us").alias(self.ts) if c == "us" else F.col(f"`{c}`") for c in df.columns])

    def stream(self, sdf: DataFrame) -> DataFrame:
        """The operator over a stream. State is kept by RocksDB, which this sets for the session."""
        spark = ship(sdf.sparkSession)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
        rows = sdf.filter(F.col(self.ts).isNotNull()).withWatermark(self.ts, self.delay)
        rows = rows.select(self.key, F.unix_micros(F.col(self.ts).cast("timestamp")).alias("us"), *[f"`{c}`" for c in self._columns()], F.col(self.ts).alias("_at"))
        kind = sdf.schema[self.key].dataType.simpleString()
        schema = StructType.fromDDL(f"`{self.key}` {kind}, {self.out}")
        work = InOrder(self.rows, self.carried, schema.names, self.step, self.forget)
        got = rows.groupBy(self.key).transformWithState(work, schema, "Append", "EventTime")
        return self._named(got)

    def rest(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """What the stream of ``checkpoint`` has not put out yet, for a source that has ended: its waiting rows, read from the state."""
        state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        waiting = state("waiting").select(F.col(f"key.{self.key}").alias("_k"), "list_element.*")
        carried = state("carried").select(F.col(f"key.{self.key}").alias("_k"), F.col("value").alias("_c"))
        both = waiting.join(carried, waiting["_k"].eqNullSafe(carried["_k"]), "left").select(waiting["_k"], "us", *[f"`{c}`" for c in self._columns()], "_c")
        names, kept = ["us", *self._columns()], StructType.fromDDL(self.carried).names
        schema = StructType.fromDDL(f"`{self.key}` {waiting.schema['_k'].dataType.simpleString()}, {self.out}")
        step, forget, arrow = self.step, self.forget, to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now: tuple | None = None
            held: tuple | None = None
            for batch in batches:
                done = []
                for r in batch.to_pylist():
                    if now != (r["_k"],):
                        now = (r["_k"],)
                        held = None if r["_c"] is None else tuple(r["_c"][c] for c in kept)
                    held, out = _advance(step, forget, held, tuple(r[c] for c in names))
                    if out is not None:
                        done.append((r["_k"], *out))
                columns = list(zip(*done, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t.type) for v, t in zip(columns, arrow, strict=True)], schema=arrow)

        ordered = both.repartition("_k").sortWithinPartitions("_k", "us", f"`{self._columns()[0]}`")
        return self._named(ordered.mapInArrow(run, schema))


def smoothing(window: int = 3, key: str = "stream_id", ts: str = "ts", order: str = "event_id", label: str = "class_name", forget: str | None = None, delay: str = "10 minutes") -> Ordered:
    """Smoothed labels: (key, order, ts, smoothed), equal to ``smooth_labels`` over all rows. What is carried is the last ``window`` labels."""

    def step(carried: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        us, no, v = row
        held = [*(carried[1] if carried else ()), v][-window:]
        votes = Counter(x for x in held if x is not None)
        best = max(votes, key=lambda x: (votes[x], -held.index(x))) if votes else ""
        return (us, held), (us, no, best)

    return Ordered(key, ts, f"us long, `{order}` long, `{label}` string", "us long, labels array<string>", f"us long, `{order}` long, smoothed string", step, _us(forget), delay)


def debouncing(schema: StructType, key: str = "stream_id", ts: str = "ts", order: str = "event_id", min_gap: float = 0.1, delay: str = "10 minutes") -> Ordered:
    """``debounce`` over a stream of the given schema. What is carried is the time of the last kept row, for as long as it matters."""
    gap = round(min_gap * 1e6)
    first = [c for c in schema.names if c == order]
    others = [c for c in schema.names if c not in (key, ts, order)]
    rows = ", ".join(["us long", *(f"`{c}` {schema[c].dataType.simpleString()}" for c in [*first, *others])])

    def step(carried: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        if carried is not None and row[0] - carried[0] < gap:
            return carried, None
        return (row[0],), row

    return Ordered(key, ts, rows, "us long", rows, step, gap, delay)


def _us(span: str | None) -> int | None:
    return None if span is None else pd.Timedelta(span) // pd.Timedelta("1us")


def smooth_stream(sdf: DataFrame, **options: Any) -> DataFrame:
    """``smoothing(**options)`` over a stream."""
    return smoothing(**options).stream(sdf)


def debounce_stream(sdf: DataFrame, **options: Any) -> DataFrame:
    """``debouncing(**options)`` over a stream."""
    return debouncing(sdf.schema, **options).stream(sdf)


def fps_stream(sdf: DataFrame, every: str = "500 milliseconds", delay: str = "10 seconds", key: str = "stream_id", ts: str = "ts") -> DataFrame:
    """Frames and rate of tumbling windows; a window is final once the watermark has passed it."""
    seconds = pd.Timedelta(every).total_seconds()
    n = sdf.withWatermark(ts, delay).groupBy(key, F.window(ts, every)).agg(F.count("*").alias("n"))
    return n.select(key, F.col("window.start").alias("start"), "n", (F.col("n") / seconds).alias("fps"))


def run_to_table(sdf: DataFrame, path: str, checkpoint: str, mode: str = "append", ordered: Ordered | None = None) -> None:
    """Run a stream over all that is there into Parquet, and stop. In complete mode the table is written anew by every batch.

    ``ordered``: the source has ended, so the rows that the operator still holds back are put out too; the stream isn't to be gone on with.
    """
    out = sdf.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", path)
    else:
        out = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    out.start().awaitTermination()
    if ordered is not None:
        ordered.rest(sdf.sparkSession, checkpoint).write.parquet(f"{path}-rest")


def written(spark: SparkSession, path: str) -> DataFrame:
    """What ``run_to_table`` has written with ``ordered``."""
    return spark.read.parquet(path).unionByName(spark.read.parquet(f"{path}-rest"))
