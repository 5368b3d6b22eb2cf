"""Running sums, extremes and carried values along an order, for groups that are too long for one task.

Rows are dealt out by ranges of key and order and numbered. Each range is summed up by itself; what the ranges before it add up to
is worked out from one row for each range and key, and handed to the ranges. A range's end cuts one key at most, so fewer rows
than there are ranges are handed on, whatever the number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: The number of a row in the order of all rows; its upper bits are the range's number.
AT = "_at"
_RANGE = "_range"
_BITS = 33


def dealt(df: DataFrame, keys: list[str], order: list[str | Column], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_at``, stored in ranges of keys and order. ``order`` should tell all rows of a key apart; ties are numbered in any order."""
    by = [*keys, *order]
    spread = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return stored(spread.sortWithinPartitions(*by).withColumn(AT, F.monotonically_increasing_id()))


def scan(rows: DataFrame, keys: list[str], made: dict[str, tuple[str, str | Column]], ahead: bool = False, exclusive: bool = False) -> DataFrame:
    """``rows`` of ``dealt`` with a running value for each name: (kind, column), kinds sum, max and last (the last that isn't null).

    From the key's first row to this one; ``ahead``: from the last row backwards to this one (so last is the next that isn't null);
    ``exclusive``: without this row. Where nothing is summed up, the value is null. Keys may be null.
    """
    rows = rows.withColumn(_RANGE, F.shiftright(AT, _BITS))
    # a frame that reaches to the end is worked out anew for each row, so what lies ahead is run through backwards
    back, along = Window.unboundedPreceding, lambda c: F.desc(c) if ahead else F.col(c)
    within = Window.partitionBy(_RANGE, *keys).orderBy(along(AT)).rowsBetween(back, -1 if exclusive else 0)
    column = lambda c: F.col(c) if isinstance(c, str) else c
    carried = lambda c: F.last(c, ignorenulls=True)
    whole = {"sum": F.sum, "max": F.max, "last": lambda c: (F.min_by if ahead else F.max_by)(c, F.when(c.isNotNull(), F.col(AT)))}
    running = {"sum": F.sum, "max": F.max, "last": carried}
    both = {
        "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "max": F.greatest,  # nulls are passed over
        "last": lambda own, handed: F.coalesce(own, handed),
    }
    totals = rows.groupBy(_RANGE, *keys).agg(*[whole[kind](column(c)).alias(n) for n, (kind, c) in made.items()])
    others = Window.partitionBy(*keys).orderBy(along(_RANGE))
    first = F.lag(_RANGE).over(others)
    others = others.rowsBetween(back, -1)
    handed = totals.select(F.col(_RANGE).alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], first.isNotNull().alias("_cut"), *[running[kind](F.col(n)).over(others).alias(f"_h_{n}") for n, (kind, _) in made.items()])
    own = rows.withColumns({n: running[kind](column(c)).over(within) for n, (kind, c) in made.items()})
    same = F.col(_RANGE) == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = own.join(F.broadcast(handed.filter("_cut")), same, "left")  # fewer rows than ranges
    return met.withColumns({n: both[kind](F.col(n), F.col(f"_h_{n}")) for n, (kind, _) in made.items()}).select(*rows.drop(_RANGE, *made).columns, *made)
