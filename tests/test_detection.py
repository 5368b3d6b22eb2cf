import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import detection as D
from sparkloom.operators import frames as R
from sparkloom.sources import tables as S
from sparkloom.streaming import frames as ST

T0 = dt.datetime(2024, 1, 1)


def test_smoothing_ties_and_gaps(spark):
    labels = ["A", None, "B", "B", "A", None, None, None]
    df = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=i), v) for i, v in enumerate(labels)], "stream_id long, ts timestamp, class_name string")
    assert [r.smoothed for r in R.smooth_labels(df).orderBy("ts").collect()] == ["A", "A", "A", "B", "B", "B", "A", ""]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, i % 3, T0 + dt.timedelta(milliseconds=37 * i), None if i % 7 == 0 else "AB"[(i // 5) % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, stream_id long, ts timestamp, class_name string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    live = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ST.run_to_table(ST.smooth_stream(live()), str(tmp_path / "a"), str(tmp_path / "ca"), ordered=ST.smoothing())
    got = {r.event_id: r.smoothed for r in ST.written(spark, str(tmp_path / "a")).collect()}
    assert got == {r.event_id: r.smoothed for r in R.smooth_labels(df).collect()}
    ST.run_to_table(ST.debounce_stream(live(), min_gap=0.25), str(tmp_path / "b"), str(tmp_path / "cb"), ordered=ST.debouncing(df.schema, min_gap=0.25))
    kept = {r.event_id for r in ST.written(spark, str(tmp_path / "b")).collect()}
    assert kept == {r.event_id for r in R.debounce(df, min_gap=0.25).collect()}
    ST.run_to_table(ST.fps_stream(live(), delay="0 seconds"), str(tmp_path / "c"), str(tmp_path / "cc"))
    final = {(r.stream_id, r.start): r.n for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    batch = {(r.stream_id, r.start): r.n for r in R.frame_rate(df).collect()}
    assert final and all(batch[k] == n for k, n in final.items())


def test_shuffled_files_are_put_in_order(spark, tmp_path):
    """Files that each hold rows of the whole hour, one a micro-batch; all lie within the delay of each other's watermark."""
    rows = [(i, i % 3, T0 + dt.timedelta(milliseconds=9137 * i, microseconds=i), None if i % 7 == 0 else "AB"[(i // 5) % 2], i / 7) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, stream_id long, ts timestamp, class_name string, confidence double")
    for i in range(7):
        df.filter(F.col("event_id") % 7 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    work = ST.smoothing(delay="2 hours")
    ST.run_to_table(work.stream(live()), str(tmp_path / "a"), str(tmp_path / "ca"), ordered=work)
    got = sorted((r.event_id, r.ts, r.smoothed) for r in ST.written(spark, str(tmp_path / "a")).collect())
    assert got == sorted((r.event_id, r.ts, r.smoothed) for r in R.smooth_labels(df, order=["ts", "event_id"]).collect())
    work = ST.debouncing(df.schema, min_gap=60.0, delay="2 hours")
    ST.run_to_table(work.stream(live()), str(tmp_path / "b"), str(tmp_path / "cb"), ordered=work)
    whole = lambda x: sorted(tuple(r[c] for c in df.columns[:3]) + (r.class_name or "", r.confidence) for r in x.collect())
    assert whole(ST.written(spark, str(tmp_path / "b"))) == whole(R.debounce(df, min_gap=60.0))


def test_waiting_rows_come_out_behind_the_watermark(spark, tmp_path):
    """Files in time order but for rows that come up to two files late: timers put out what the watermark has passed, the rest at the end."""
    rows = [(i, i % 2, T0 + dt.timedelta(seconds=i), "AB"[(i // 3) % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, stream_id long, ts timestamp, class_name string")
    for i in range(6):
        late = [r for r in rows if (r[0] // 50 + (r[0] % 11 == 0) + (r[0] % 13 == 0)) == i]
        spark.createDataFrame(late, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sent = df.filter("event_id div 50 + int(event_id % 11 = 0) + int(event_id % 13 = 0) < 6")
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    work = ST.smoothing(delay="2 minutes 30 seconds")
    ST.run_to_table(work.stream(live), str(tmp_path / "a"), str(tmp_path / "ca"), ordered=work)
    early, rest = (spark.read.parquet(str(tmp_path / x)) for x in ("a", "a-rest"))
    assert early.count() > 100 and 0 < rest.count() <= 152
    assert early.agg(F.max("ts")).first()[0] < rest.agg(F.min("ts")).first()[0]
    got = {r.event_id: r.smoothed for r in early.unionByName(rest).collect()}
    assert got == {r.event_id: r.smoothed for r in R.smooth_labels(sent).collect()}


def test_streams_forget(spark, tmp_path):
    """A stream whose next row comes later than the limit starts afresh, whether its state is gone already or not; null times are left out."""
    at = [0, 1, 2, 400, 401, 9000]
    rows = [(i, 1, T0 + dt.timedelta(seconds=t), v) for i, (t, v) in enumerate(zip(at, "AABBAA", strict=True))] + [(7, 2, T0 + dt.timedelta(hours=5), "C"), (8, 2, None, "D")]
    df = spark.createDataFrame(rows, "event_id long, stream_id long, ts timestamp, class_name string")
    for part in (df.filter("event_id < 5"), df.filter("event_id >= 5")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    work = ST.smoothing(forget="5 minutes", delay="10 seconds")
    ST.run_to_table(work.stream(live), str(tmp_path / "a"), str(tmp_path / "ca"), ordered=work)
    assert {r.event_id: r.smoothed for r in ST.written(spark, str(tmp_path / "a")).collect()} == {0: "A", 1: "A", 2: "A", 3: "B", 4: "B", 5: "A", 7: "C"}


def test_progress_stream(spark, tmp_path):
    df = spark.createDataFrame([("A",)] * 5 + [("B",)] * 20, "class_name string")
    df.write.parquet(str(tmp_path / "in"))
    seen = {}
    q = ST.capture_progress(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 10).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.update({r.class_name: (r.captured, r.share) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == {"A": (5, 0.5), "B": (20, 1.0)}


def test_split_counts(spark):
    rows = [(f"{c}{i}", c) for c, n in (("a", 3), ("b", 10), ("c", 25)) for i in range(n)]
    out = D.stratified_split(spark.createDataFrame(rows, "image_id string, class_id string"), "class_id")
    got = {(r.class_id, r.split): r.n for r in D.class_distribution(out).collect()}
    assert got == {("a", "train"): 2, ("a", "test"): 1, ("b", "train"): 8, ("b", "val"): 1, ("b", "test"): 1, ("c", "train"): 20, ("c", "val"): 2, ("c", "test"): 3}


def test_report_of_empty_classes(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "true_cls int, pred_cls int")
    classes = spark.createDataFrame([(0,), (1,), (2,)], "class_id int")
    got = {r.class_id: (r.precision, r.recall, r.support) for r in D.classification_report(D.confusion_matrix(pairs), classes).collect()}
    assert got == {0: (1.0, 0.5, 2), 1: (0.5, 1.0, 1), 2: (0.0, 0.0, 0)}
    assert D.confusion_table(D.confusion_matrix(pairs), 3).count() == 2


def test_known_classes_and_minimum(spark):
    df = spark.createDataFrame([("A",), ("thumbsUP",), ("Q",)], "class_name string")
    assert {r.class_id for r in D.known_classes(df).collect()} == {0, 8}
    assert {r.class_id for r in D.known_classes(df, strict=True).collect()} == {0}
    few = D.check_minimum(D.known_classes(df), spark.createDataFrame([(0,), (1,)], "class_id int"), 1)
    assert {r.class_id: (r.n, r.enough) for r in few.collect()} == {0: (1, True), 1: (0, False)}


def test_labels(spark):
    df = spark.createDataFrame([("a", 0, "3 0.5 0.5 0.25 1"), ("a", 1, "1 0 0 0 0"), ("b", 0, "1 2 3")], "image_id string, line_no int, line string")
    assert D.parse_labels(df).count() == 2
    r = D.parse_labels(df, first_only=True).collect()
    assert [(x.image_id, x.class_id, x.w) for x in r] == [("a", 3, 0.25)]


BOX = "image_id long, class_id int, det_no int, confidence double, x1 double, y1 double, x2 double, y2 double"


def test_map_of_perfect_and_partial(spark):
    gts = spark.createDataFrame([(i, 0, 0, 0.0, 0.0, 1.0, 1.0) for i in range(4)], "image_id long, class_id int, gt_no int, x1 double, y1 double, x2 double, y2 double")
    right = spark.createDataFrame([(i, 0, 0, 0.9, 0.0, 0.0, 1.0, 1.0) for i in range(4)], BOX)
    r = D.detection_map(right, gts).first()
    assert (r.map50, r.map50_95, r.precision, r.recall) == (1.0, 1.0, 1.0, 1.0)
    half = spark.createDataFrame([(0, 0, 0, 0.9, 0.0, 0.0, 1.0, 1.0), (1, 0, 0, 0.8, 5.0, 5.0, 6.0, 6.0), (2, 0, 0, 0.7, 0.0, 0.0, 1.0, 1.0), (2, 0, 1, 0.6, 0.0, 0.0, 1.0, 1.0)], BOX)
    r = D.detection_map(half, gts).first()
    assert r.map50 == pytest.approx((26 * 1.0 + 25 * 2 / 3) / 101)
    assert r.precision == 0.5 and r.recall == 0.5


def test_missed_images_count_on_request(spark):
    truth = spark.createDataFrame([(1, 0), (2, 1)], "image_id long, class_id int")
    dets = spark.createDataFrame([(1, 0, 0, 0.9)], "image_id long, det_no int, class_id int, confidence double")
    assert D.pair_predictions(truth, dets).count() == 1
    assert {r.pred_cls for r in D.pair_predictions(truth, dets, count_missed=True).collect()} == {0, -1}


def test_sales_csv_and_submission(spark, tmp_path):
    for name, text in {
        "train": "id,date,store_nbr,family,sales,onpromotion\n1,2020-01-01,1,A,2.5,\n", "test": "id,date,store_nbr,family,onpromotion\n2,2020-01-02,1,A,3\n", "stores": "store_nbr,city,state,type,cluster\n1,c,s,A,4\n",
        "oil": "date,dcoilwtico\n2020-01-01,\n2020-01-02,50\n", "holidays_events": "date,type,locale,locale_name,description,transferred\n2020-01-01,Holiday,National,x,y,False\n", "transactions": "date,store_nbr,transactions\n2020-01-01,1,9\n",
    }.items():
        (tmp_path / f"{name}.csv").write_text(text)
    from sparkloom.operators.panel import build_master

    train, test = build_master(S.read_sales_tables(spark, str(tmp_path)))
    r = train.first()
    assert (r.onpromotion, r.oil_price, r.holiday_type, r.transactions, str(r.date)) == (0, 50.0, "Holiday", 9, "2020-01-01")
    S.write_submission(test.select("id", F.lit(1.5).alias("sales")), str(tmp_path / "out"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().asDict() == {"id": "2", "sales": "1.5"}


def test_image_and_label_files(spark, tmp_path):
    for p in ("A/x.jpg", "A/y.png", "B/z.jpg", "B/n.txt"):
        (tmp_path / "img" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / p).write_bytes(b"1")
    assert sorted(r.class_name for r in S.list_images(spark, str(tmp_path / "img")).collect()) == ["A", "A", "B"]
    (tmp_path / "lab").mkdir()
    (tmp_path / "lab" / "x.txt").write_text("3 0.5 0.5 0.25 1\n1 0 0 0 0\n")
    assert [(r.image_id, r.line_no) for r in S.read_label_lines(spark, str(tmp_path / "lab")).orderBy("line_no").collect()] == [("x", 0), ("x", 1)]
    m = spark.createDataFrame([("x", "A", 0, "train", [0.5, 0.5, 0.1, 0.1])], S.MANIFEST)
    S.write_manifest(m, str(tmp_path / "m"))
    assert spark.read.schema(S.MANIFEST).json(str(tmp_path / "m")).collect() == m.collect()
    S.write_eval(m.select("image"), m.select("split"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e" / "results")).count() == 1
    S.write_label_lines(spark.createDataFrame([("x", "0 0 0 0 0")], "image_id string, line string"), str(tmp_path / "w"))
