"""Exact quantiles by distributed selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from ..session import stored

#: Share of the values on each side of a quantile that a first bracket takes in.
NEAR = 0.002


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] = (), near: float = NEAR) -> DataFrame:
    """(by, name, p, value): interpolated quantiles of each column over its non-null values, per group of ``by`` (null if it has none).

    A sketch brackets each quantile between two values. Only counts of what lies below the bracket and the distinct values inside it are
    taken further, and those are ranked by a scan over ranges, so no task holds a column. A bracket that misses its ranks is made four
    times as wide. NaN is the largest value.
    """
    by = list(by)
    long = stored(df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(*by, "x.*").filter("v IS NOT NULL"))
    keys = [*by, "name"]
    todo = long.groupBy(*keys).count().withColumnRenamed("count", "n").withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = stored(todo.withColumns({"k": F.floor(F.col("p") * (F.col("n") - 1)), "k2": F.ceil(F.col("p") * (F.col("n") - 1))}))
    found = None
    while True:
        ends = sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-near, near)})
        sketch = long.groupBy(*keys).agg(F.percentile_approx("v", F.array(*[F.lit(e) for e in ends]), int(4 / near)).alias("q"))
        at = lambda s: F.element_at("q", F.array_position(F.array(*[F.lit(e) for e in ends]), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") + s))).cast("int"))  # noqa: B023, E731
        # a row for each group, column and quantile
        both = sketch.join(wanted, _same(sketch, wanted, keys)).select(*[wanted[k] for k in keys], "p", "n", "k", "k2", at(-near).alias("lo"), at(near).alias("hi"))
        bracket = stored(both)
        b = bracket.select(*[F.col(k).alias(f"_{k}") for k in keys], "p", "k", "k2", "lo", "hi")
        met = long.join(b, _pairs(keys))
        kinds = F.when(F.col("v") < F.col("lo"), F.lit(float("-inf"))).otherwise(F.col("v"))  # all that lies below is one kind
        inside = met.filter(F.col("v") <= F.col("hi")).groupBy(*keys, "p", "k", "k2", (F.col("v") < F.col("lo")).alias("below"), kinds.alias("v")).agg(F.count("*").alias("m"))
        own = [*keys, "p"]
        ranked = scans.scan(scans.dealt(inside, own, [F.desc("below"), "v"]), own, {"upto": ("sum", "m")})
        holds = lambda k: (F.col("upto") > F.col(k)) & (F.col("upto") - F.col("m") <= F.col(k)) & ~F.col("below")
        hit = ranked.groupBy(*own).agg(F.min(F.when(holds("k"), F.col("v"))).alias("a"), F.min(F.when(holds("k2"), F.col("v"))).alias("b"))
        done = stored(hit.filter("a IS NOT NULL AND b IS NOT NULL"))
        found = done if found is None else found.unionByName(done)
        left = wanted.join(done.select(*[F.col(c).alias(f"_{c}") for c in own]), _pairs(own), "left_anti")
        if near >= 1 or not left.limit(1).count():
            break
        near, wanted = min(1.0, 4 * near), stored(left)
    whole = df.select(*by).distinct().crossJoin(F.broadcast(df.sparkSession.createDataFrame([(c, float(p)) for c in cols for p in probs], "name string, p double"))) if by else df.sparkSession.createDataFrame([(c, float(p)) for c in cols for p in probs], "name string, p double")
    sizes = todo.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("p").alias("_p"), "n")
    full = found.join(sizes, _pairs([*keys, "p"])).withColumn("value", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") * (F.col("n") - 1) - F.floor(F.col("p") * (F.col("n") - 1)))))
    full = full.select(*[F.col(c).alias(f"_{c}") for c in [*keys, "p"]], "value")
    return whole.join(full, _pairs([*keys, "p"]), "left").select(*keys, "p", "value")


def _pairs(keys: list[str]):
    """Equality, also of nulls, of columns and the same with an underscore in front."""
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return same


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    same = F.lit(True)
    for k in keys:
        same &= a[k].eqNullSafe(b[k])
    return same
