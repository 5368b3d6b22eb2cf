"""Scans over ranges: against windows, with keys cut by range ends, and what is built on them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import quantiles as Q
from sparkloom.operators import detection as D
from sparkloom.operators import features as X
from sparkloom.operators import panel as P
from sparkloom.operators import scans as S


def numbers(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "b", "b", "b", "b", "c"]), i, rng.choice([None, None, rng.randint(-9, 9)])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, v int").repartition(3)


def lists(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("ahead", [False, True])
def test_scans_equal_windows(spark, keys, exclusive, ahead):
    df = numbers(spark)
    placed = S.dealt(df, keys, ["t"], ranges=23)
    assert placed.select(F.shiftright(S.AT, 33)).distinct().count() > 15
    got = S.scan(placed, keys, {"s": ("sum", "v"), "m": ("max", F.col("v") * 2), "l": ("last", "v"), "n": ("sum", F.lit(1))}, ahead, exclusive)
    w = Window.partitionBy(*keys).orderBy("t")
    w = w.rowsBetween(1 if exclusive else 0, Window.unboundedFollowing) if ahead else w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    carried = (F.first if ahead else F.last)("v", ignorenulls=True)
    want = df.select("k", "t", "v", F.sum("v").over(w).alias("s"), F.max(F.col("v") * 2).over(w).alias("m"), carried.over(w).alias("l"), F.sum(F.lit(1)).over(w).alias("n"))
    assert lists(got.drop(S.AT)) == lists(want)
    assert S.scan(S.dealt(df.limit(0), keys, ["t"]), keys, {"s": ("sum", "v")}, ahead, exclusive).count() == 0


def into_one_task(df):
    """What each exchange of a plan into a single partition takes in."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines() + df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    return [" ".join(lines[i + 1 : i + 3]) for i, x in enumerate(lines) if "SinglePartition" in x]


def test_long_series_are_filled_over_ranges(spark):
    df = numbers(spark).select("t", "v", F.lit("extra").alias("x"))
    want = P.ffill_bfill(df, "v", "t")
    got = P.ffill_bfill(df, "v", "t", rows=100)
    assert lists(got.select("t", "v", "x")) == lists(want.select("t", "v", "x"))
    rows = S.dealt(df, [], ["t"], ranges=9)
    one = S.scan(rows, [], {"before": ("last", "v")})
    one.collect()
    # what goes into one task are sums of ranges, not the table
    assert all("Aggregate" not in x for x in into_one_task(want)) and len(into_one_task(want)) == 1
    assert all("Aggregate" in x for x in into_one_task(one)) and len(into_one_task(one)) == 1


def test_asof_without_keys_over_ranges(spark):
    df = numbers(spark, 800, 5)
    left, events = df.select("t").filter("t % 3 > 0"), df.filter("v > 3").select("t")
    for f in (X.asof_next, X.asof_prev):
        for exact in (False, True):
            assert lists(f(left, events, on="t", exact=exact, ranges=True)) == lists(f(left, events, on="t", exact=exact))
            keyed = df.filter("k is not null").select("k", "t"), df.filter("v > 3 and k is not null").select("k", "t")
            assert lists(f(*keyed, on="t", keys=["k"], exact=exact, ranges=True)) == lists(f(*keyed, on="t", keys=["k"], exact=exact))


def test_a_hot_series_is_split(spark):
    """A series with over a third of all rows: same features, and no task has twice the rows of the median one."""
    rng = random.Random(9)
    days = [(1, "hot", i) for i in range(12_000)] + [(s, f, i) for s in range(50) for f in ("a", "b") for i in range(rng.randint(1, 480))]
    rows = [(s, f, i, float(rng.randint(0, 50)), rng.randint(0, 3)) for s, f, i in days]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "store_nbr int, family string, day int, sales double, onpromotion int").withColumn("date", F.date_add(F.lit("1990-01-01").cast("date"), F.col("day"))).drop("day")
    features = lambda x: X.add_rolling(X.add_lags(X.add_promo_counts(x)))
    halved = X.split_series(df, 400)
    plain = features(df)
    rounded = lambda x: lists(x.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in sorted(plain.dtypes)]))
    assert rounded(X.join_series(features(halved))) == rounded(plain)
    sizes = sorted(r["count"] for r in halved.groupBy("store_nbr", "family", "_piece").count().collect())
    assert sizes[-1] <= 400 + 365
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = lambda x: sorted(r.n for r in x.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count("sales_lag_7")).collect())
        split, whole = tasks(features(halved)), tasks(plain)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert split[-1] < 2 * split[len(split) // 2] and whole[-1] > 2 * whole[len(whole) // 2 - 1]
    with pytest.raises(ValueError):
        X.split_series(df, 300)


def test_matches_stream_by(spark):
    """Boxes are given away one to one within image and class, across batches, and a class over many ranges has the same precision."""
    rng = random.Random(4)
    box = lambda x: (x, 0.0, x + 10.0, 10.0)
    truth = [(i, i % 2, g, *box(20.0 * g)) for i in range(60) for g in range(4)]
    preds = [(i, i % 2, d, round(rng.random(), 3), *box(20.0 * rng.randrange(5) + rng.choice([0, 1, 3, 6]))) for i in range(60) for d in range(6)]
    t = spark.createDataFrame(truth, "image_id long, class_id int, gt_no int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(preds, "image_id long, class_id int, det_no int, confidence double, x1 double, y1 double, x2 double, y2 double")
    want = []
    for thr in (0.5, 0.75):
        for i in range(60):
            used = set()
            for d in sorted((x for x in preds if x[0] == i), key=lambda x: (-x[3], x[2])):
                over = lambda g: max(0.0, min(d[6], g[5]) - max(d[4], g[3])) / (20 - max(0.0, min(d[6], g[5]) - max(d[4], g[3])))  # noqa: B023, E731
                near = sorted(((-over(g), g[2]) for g in truth if g[0] == i and g[2] not in used))
                hit = bool(near) and -near[0][0] >= thr
                if hit:
                    used.add(near[0][1])
                want.append((i, i % 2, d[2], d[3], thr, hit))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = D.match_boxes(p, t, [0.5, 0.75])
        assert lists(got) == sorted(want, key=str)
        few = D.detection_map(p, t).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert few == D.detection_map(p, t).first() and 0 < few.map50_95 < few.map50 < 1


def test_quantiles_are_exact(spark):
    """Against sorted lists: ties, nulls, empty and constant columns, groups, and brackets that miss at first."""
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, float(rng.randint(0, 9)), rng.gauss(0, 1e6)]), 3, None) for _ in range(4000)] + [("one", 5.0, 3, None)]
    df = spark.createDataFrame(rows, "g string, x double, c int, e double").repartition(5)

    def want(values, p):
        v = sorted(x for x in values if x is not None)
        at = p * (len(v) - 1)
        low = int(at)
        return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low) if v else None

    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    for near in (0.002, 1e-5):
        got = {(r.name, r.p): r.value for r in Q.exact_quantiles(df, ["x", "c", "e"], probs, near=near).collect()}
        assert got == {(n, p): pytest.approx(want([r[i] for r in rows], p)) for i, n in ((1, "x"), (2, "c"), (3, "e")) for p in probs}
    got = {(r.g, r.p): r.value for r in Q.exact_quantiles(df, ["x"], [0.5, 0.95], ["g"]).collect()}
    assert got == {(g, p): pytest.approx(want([r[1] for r in rows if r[0] == g], p)) for g in (None, "a", "b", "one") for p in (0.5, 0.95)}
    assert [r.value for r in Q.exact_quantiles(df.limit(0), ["x"], [0.5]).collect()] == [None]


def test_no_frame_reaches_to_the_end(spark):
    """Such a frame is worked out anew for each row, which takes the square of a range."""
    from sparkloom.operators import scans

    rows = scans.dealt(spark.range(20).selectExpr("id % 2 AS k", "id AS o", "IF(id % 3 = 0, id, NULL) AS v"), ["k"], ["o"], 5)
    got = scans.scan(rows, ["k"], {"s": ("sum", "o"), "m": ("max", "v"), "l": ("last", "v")}, ahead=True)
    assert "UNBOUNDED FOLLOWING" not in (plan := got._jdf.queryExecution().optimizedPlan().toString().upper()) and "UNBOUNDEDFOLLOWING" not in plan
    for r in got.collect():
        left = [x for x in range(20) if x % 2 == r.k and x >= r.o]
        held = [x for x in left if x % 3 == 0]
        assert (r.s, r.m, r.l) == (sum(left), max(held, default=None), min(held, default=None))
