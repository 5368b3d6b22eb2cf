"""Queries over detection data and frames derived from the provided tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import detection as D
from ..operators import features as X
from ..operators import forecast as C
from ..operators import frames as R
from ..streaming import frames as S
from ..session import new_path, stored
from . import sales
from .testtables import alone, read, round_all, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Images are the vectors: 21 points of each make its landmarks, its label modulo 10 its class. A detection is the class of the
#: next vector's label with a confidence from its first component; every 13th image has none.
CTES = """
landmarks AS (SELECT vec_id AS image_id, i, 0.5::DOUBLE + embedding[2 * i - 1]::DOUBLE AS x, 0.5::DOUBLE + embedding[2 * i]::DOUBLE AS y FROM embeddings, range(1, 22) t(i)),
boxes AS (SELECT image_id, x1, y1, x2, y2, (x1 + x2) / 2 AS x_c, (y1 + y2) / 2 AS y_c, x2 - x1 AS w, y2 - y1 AS h FROM (SELECT image_id, GREATEST(MIN(x) - 0.08::DOUBLE, 0) AS x1, GREATEST(MIN(y) - 0.08::DOUBLE, 0) AS y1, LEAST(MAX(x) + 0.08::DOUBLE, 1) AS x2, LEAST(MAX(y) + 0.08::DOUBLE, 1) AS y2 FROM landmarks GROUP BY 1)),
truth AS (SELECT vec_id AS image_id, CAST(label % 10 AS INT) AS class_id FROM embeddings),
dets AS (SELECT vec_id AS image_id, CAST(d AS INT) AS det_no, CAST(CASE WHEN vec_id % 3 = d THEN (label + 1) % 10 ELSE label % 10 END AS INT) AS class_id, abs(embedding[d + 1]::DOUBLE * 5) - floor(abs(embedding[d + 1]::DOUBLE * 5)) AS confidence FROM embeddings, range(0, 2) t(d) WHERE vec_id % 13 <> 0),
top AS (SELECT image_id, arg_max(class_id, confidence * 1000 - det_no * 0.0000001::DOUBLE) AS pred_cls FROM dets WHERE confidence >= 0.25 GROUP BY 1),
pairs AS (SELECT image_id, class_id AS true_cls, pred_cls FROM truth JOIN top USING (image_id)),
cm AS (SELECT true_cls, pred_cls, COUNT(*) AS n FROM pairs GROUP BY 1, 2),
classes AS (SELECT CAST(i AS INT) AS class_id FROM range(0, 12) t(i)),
frames AS (SELECT user_id AS stream_id, ts, event_id, CASE WHEN value / 500 >= 0.1 THEN event_type END AS class_name, value / 500 AS confidence FROM events)"""


def oracle(sql: str) -> str:
    """``sql`` behind the tables."""
    own = sql.removeprefix("WITH ").strip()
    return f"WITH RECURSIVE {CTES.strip()}{', ' if sql.startswith('WITH ') else ' '}{own}"


def query(name: str, sql: str, cols: str = "", checked: bool = True):
    def put(f):
        QUERIES[name] = alone(lambda spark, d: round_all(f(spark, d)))
        if checked:
            ORACLE_SQL[name] = oracle(rounded(sql, cols) if cols else sql)
        return f

    return put


def landmarks(s, d) -> DataFrame:
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.slice("embedding", 1, 42).alias("e"))
    point = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct((F.lit(0.5) + F.get("e", 2 * i).cast("double")).alias("x"), (F.lit(0.5) + F.get("e", 2 * i + 1).cast("double")).alias("y")))
    return v.select("image_id", F.explode(F.when(F.size("e") > 0, point)).alias("p")).select("image_id", "p.x", "p.y")


def truth(s, d) -> DataFrame:
    return read(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("label") % 10).cast("int").alias("class_id"))


def detections(s, d) -> DataFrame:
    e = read(s, d, "embeddings").filter("vec_id % 13 <> 0").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    c = F.abs(F.get("embedding", F.col("d")).cast("double") * 5)
    return e.select(F.col("vec_id").alias("image_id"), F.col("d").alias("det_no"), F.when(F.col("vec_id") % 3 == F.col("d"), (F.col("label") + 1) % 10).otherwise(F.col("label") % 10).cast("int").alias("class_id"), (c - F.floor(c)).alias("confidence"))


def classes(s) -> DataFrame:
    return s.range(12, numPartitions=1).select(F.col("id").cast("int").alias("class_id"))


def frames(s, d) -> DataFrame:
    share = F.col("value") / 500
    return read(s, d, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", F.when(share >= 0.1, F.col("event_type")).alias("class_name"), share.alias("confidence"))


@query("landmark_boxes", "SELECT * FROM boxes", "x1 y1 x2 y2 x_c y_c w h")
def _(s, d):
    return D.boxes_from_landmarks(landmarks(s, d))


@query("pixel_boxes", (
    "SELECT image_id, CAST(trunc((x_c - w / 2) * 640) AS INT) AS px1, CAST(trunc((y_c - h / 2) * 480) AS INT) AS py1, "
    "CAST(trunc((x_c + w / 2) * 640) AS INT) AS px2, CAST(trunc((y_c + h / 2) * 480) AS INT) AS py2 FROM boxes"
))
def _(s, d):
    return D.center_to_pixels(D.boxes_from_landmarks(landmarks(s, d)), 640, 480).select("image_id", "px1", "py1", "px2", "py2")


@query("label_lines", (
    "SELECT image_id, printf('%d %.6f %.6f %.6f %.6f', class_id, ROUND(x_c, 4), ROUND(y_c, 4), ROUND(w, 4), ROUND(h, 4)) AS line FROM boxes "
    "JOIN truth USING (image_id)"
))
def _(s, d):
    b = D.boxes_from_landmarks(landmarks(s, d)).withColumns({c: F.round(c, 4) for c in ("x_c", "y_c", "w", "h")})
    return D.format_labels(b.join(truth(s, d), "image_id"))


@query("parsed_labels", (
    "SELECT image_id, class_id, ROUND(x_c, 4) AS x_c, ROUND(y_c, 4) AS y_c, ROUND(w, 4) AS w, ROUND(h, 4) AS h FROM boxes JOIN truth "
    "USING (image_id) WHERE image_id % 5 <> 0"
))
def _(s, d):
    b = D.boxes_from_landmarks(landmarks(s, d)).withColumns({c: F.round(c, 4) for c in ("x_c", "y_c", "w", "h")})
    lines = D.format_labels(b.join(truth(s, d), "image_id"))
    broken = lines.withColumn("line", F.when(F.col("image_id") % 5 == 0, F.concat("line", F.lit(" x"))).otherwise(F.col("line")))
    return D.parse_labels(broken)


@query("fallback_boxes", (
    "SELECT t.image_id, CASE WHEN t.image_id % 11 = 1 THEN 'no_detector' WHEN t.image_id % 11 = 2 THEN 'no_hand' ELSE 'ok' END AS status, CASE "
    "WHEN t.image_id % 11 IN (1, 2) THEN 0.5::DOUBLE ELSE x_c END AS x_c, CASE WHEN t.image_id % 11 IN (1, "
    "2) THEN 0.5::DOUBLE ELSE y_c END AS y_c, CASE t.image_id % 11 WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE w END AS w, "
    "CASE t.image_id % 11 WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE h END AS h FROM truth t LEFT JOIN boxes USING (image_id) "
    "WHERE t.image_id % 11 <> 3"
), "x_c y_c w h")
def _(s, d):
    k = F.col("image_id") % 11
    images = truth(s, d).select("image_id", F.when(k == 1, "no_detector").when(k == 2, "no_hand").when(k == 3, "unreadable").otherwise("ok").alias("status"))
    own = D.boxes_from_landmarks(landmarks(s, d)).filter(~(F.col("image_id") % 11).isin(1, 2))
    return D.fallback_boxes(images, own).select("image_id", "status", "x_c", "y_c", "w", "h")


@query("annotation_stats", (
    "SELECT COUNT(*) FILTER (image_id % 11 <> 3) AS processed, COUNT(*) FILTER (image_id % 11 = 2) AS no_hand, COUNT(*) "
    "FILTER (image_id % 11 = 3) AS errors FROM truth"
))
def _(s, d):
    k = F.col("image_id") % 11
    return D.annotation_stats(truth(s, d).withColumn("status", F.when(k == 1, "no_detector").when(k == 2, "no_hand").when(k == 3, "unreadable").otherwise("ok")))


@query("class_names", (
    "SELECT class_id, CASE WHEN class_id < 10 THEN list_extract(['A', 'B', 'C', 'D', 'E', 'L', 'V', 'Y', 'thumbsup', 'thumbsdown'], "
    "class_id + 1) ELSE 'unknown' END AS name, COUNT(*) AS n FROM (SELECT CAST(label + vec_id % 4 AS INT) AS class_id FROM embeddings) GROUP BY 1"
))
def _(s, d):
    ids = read(s, d, "embeddings").select((F.col("label") + F.col("vec_id") % 4).cast("int").alias("class_id"))
    return ids.groupBy("class_id", D.class_name(F.col("class_id")).alias("name")).agg(F.count("*").alias("n"))


@query("known_classes", "SELECT class_id, COUNT(*) AS n FROM truth GROUP BY 1")
def _(s, d):
    return D.known_classes(truth(s, d).withColumn("class_name", F.upper(D.class_name(F.col("class_id")))).drop("class_id")).groupBy("class_id").agg(F.count("*").alias("n"))


@query("split_counts", (
    "SELECT class_id, unnest(['train', 'val', 'test']) AS split, unnest([floor(n * 0.8::DOUBLE)::BIGINT, floor(n * 0.1::DOUBLE)::BIGINT, "
    "n - floor(n * 0.8::DOUBLE)::BIGINT - floor(n * 0.1::DOUBLE)::BIGINT]) AS n FROM (SELECT class_id, COUNT(*) AS n FROM truth GROUP BY 1)"
))
def _(s, d):
    return D.class_distribution(D.stratified_split(truth(s, d), "class_id"))


@query("dataset_minimum", (
    "SELECT class_id, CAST(COALESCE(n, 0) AS BIGINT) AS n, COALESCE(n, 0) >= 20 AS enough, (SELECT COUNT(*) "
    "FROM truth) >= 12 * 20 AS total_enough FROM classes LEFT JOIN (SELECT class_id, COUNT(*) AS n FROM truth GROUP BY 1) USING (class_id)"
))
def _(s, d):
    return D.check_minimum(truth(s, d), classes(s))


@query("confident_detections", "SELECT class_id, COUNT(*) AS n FROM dets WHERE confidence >= 0.4 GROUP BY 1")
def _(s, d):
    return D.filter_detections(detections(s, d), 0.4).groupBy("class_id").agg(F.count("*").alias("n"))


@query("paired_predictions", "SELECT * FROM pairs")
def _(s, d):
    return D.pair_predictions(truth(s, d), detections(s, d))


@query("confusion_matrix", "SELECT * FROM cm")
def _(s, d):
    return D.confusion_matrix(D.pair_predictions(truth(s, d), detections(s, d)))


@query("confusion_with_misses", "SELECT class_id AS true_cls, COALESCE(pred_cls, -1) AS pred_cls, COUNT(*) AS n FROM truth LEFT JOIN top USING (image_id) GROUP BY 1, 2")
def _(s, d):
    return D.confusion_matrix(D.pair_predictions(truth(s, d), detections(s, d), count_missed=True))


@query("confusion_normalized", "SELECT true_cls, pred_cls, n, n / SUM(n) OVER (PARTITION BY true_cls) AS share FROM cm", "share")
def _(s, d):
    return D.normalize_confusion(D.confusion_matrix(D.pair_predictions(truth(s, d), detections(s, d))))


@query("classification_report", (
    "SELECT class_id, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, "
    "support FROM (SELECT class_id, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS precision, CASE "
    "WHEN support > 0 THEN hit / support ELSE 0 END AS recall, support FROM (SELECT class_id, COALESCE((SELECT SUM(n) FROM cm "
    "WHERE true_cls = class_id AND pred_cls = class_id), 0)::BIGINT AS hit, COALESCE((SELECT SUM(n) FROM cm WHERE pred_cls = class_id), "
    "0)::BIGINT AS called, COALESCE((SELECT SUM(n) FROM cm WHERE true_cls = class_id), 0)::BIGINT AS support FROM classes))"
), "precision recall f1")
def _(s, d):
    return D.classification_report(D.confusion_matrix(D.pair_predictions(truth(s, d), detections(s, d))), classes(s))


@query("latency_report", (
    "SELECT event_type AS config, AVG(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, "
    "0.99) AS p99, 1000 / AVG(value) AS fps, CASE WHEN AVG(value) < 30 THEN 'PASS' WHEN AVG(value) < 100 THEN 'WARN' ELSE 'FAIL' END AS verdict "
    "FROM events GROUP BY 1"
), "mean p50 p95 p99 fps")
def _(s, d):
    return D.latency_report(read(s, d, "events").select(F.col("event_type").alias("config"), F.col("value").alias("ms")))


@query("box_overlap", (
    "SELECT image_id, CASE WHEN inter > 0 THEN inter / (wa * ha + wb * hb - inter) ELSE 0 END AS iou FROM (SELECT a.image_id, "
    "GREATEST(LEAST(a.x2, b.x2) - GREATEST(a.x1, b.x1), 0) * GREATEST(LEAST(a.y2, b.y2) - GREATEST(a.y1, b.y1), 0) AS inter, a.w AS wa, "
    "a.h AS ha, b.w AS wb, b.h AS hb FROM boxes a JOIN boxes b ON b.image_id = a.image_id + 1)"
), "iou")
def _(s, d):
    b = D.boxes_from_landmarks(landmarks(s, d))
    prefixed = lambda p, shift: b.select((F.col("image_id") + shift).alias("image_id"), *[F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")])
    return prefixed("a_", 0).join(prefixed("b_", -1), "image_id").select("image_id", D.iou("a_", "b_").alias("iou"))


#: One box a true image, so of the detections that overlap it enough the most confident one is right.
_MAP = """
WITH thr AS (SELECT ROUND(0.5::DOUBLE + i * 0.05::DOUBLE, 2) AS iou_thr FROM range(0, 10) t(i)),
gts AS (SELECT t.image_id, t.class_id, x1, y1, x2, y2 FROM truth t JOIN boxes USING (image_id)),
preds AS (SELECT d.image_id, d.det_no, d.class_id, d.confidence, x1 + confidence * 0.1::DOUBLE AS x1, y1, x2 + confidence * 0.1::DOUBLE AS x2, y2 FROM dets d JOIN boxes USING (image_id)),
met AS (SELECT p.image_id, p.det_no, p.class_id, p.confidence, GREATEST(LEAST(p.x2, g.x2) - GREATEST(p.x1, g.x1), 0) * GREATEST(LEAST(p.y2, g.y2) - GREATEST(p.y1, g.y1), 0) AS inter,
  (p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS areas FROM preds p LEFT JOIN gts g ON p.image_id = g.image_id AND p.class_id = g.class_id),
tried AS (SELECT *, COALESCE(inter / (areas - inter), 0) >= iou_thr AS near FROM met, thr),
hit AS (SELECT *, near AND row_number() OVER (PARTITION BY image_id, class_id, iou_thr, near ORDER BY confidence DESC, det_no) = 1 AS tp FROM tried),
n AS (SELECT class_id, COUNT(*) AS n_gt FROM gts GROUP BY 1),
run AS (SELECT class_id, iou_thr, n_gt, COUNT(*) OVER w AS seen, SUM(CAST(tp AS INT)) OVER w AS tp_run FROM hit JOIN n USING (class_id) WINDOW w AS (PARTITION BY class_id, iou_thr ORDER BY confidence DESC, image_id, det_no ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT *, tp_run / seen AS precision, tp_run / n_gt AS recall FROM run),
env AS (SELECT *, MAX(precision) OVER (PARTITION BY class_id, iou_thr ORDER BY seen ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM curve),
at_recall AS (SELECT class_id, iou_thr, r, MAX(CASE WHEN ROUND(recall * 100, 9) >= r THEN best ELSE 0 END) AS p FROM env, range(0, 101) t(r) GROUP BY 1, 2, 3),
ap AS (SELECT class_id, iou_thr, SUM(p) / 101 AS ap FROM at_recall GROUP BY 1, 2),
ends AS (SELECT class_id, iou_thr, arg_max(precision, seen) AS precision, MAX(recall) AS recall FROM curve GROUP BY 1, 2),
whole AS (SELECT class_id, iou_thr, COALESCE(ap, 0) AS ap, COALESCE(precision, 0) AS precision, COALESCE(recall, 0) AS recall FROM n CROSS JOIN thr LEFT JOIN ap USING (class_id, iou_thr) LEFT JOIN ends USING (class_id, iou_thr))
SELECT ROUND(AVG(ap) FILTER (iou_thr = 0.5), 6) AS map50, ROUND(AVG(ap), 6) AS map50_95, ROUND(AVG(precision) FILTER (iou_thr = 0.5), 6) AS precision, ROUND(AVG(recall) FILTER (iou_thr = 0.5), 6) AS recall FROM whole"""


@query("detection_map", _MAP.strip())
def _(s, d):
    b = D.boxes_from_landmarks(landmarks(s, d)).select("image_id", "x1", "y1", "x2", "y2")
    gts = truth(s, d).join(b, "image_id").withColumn("gt_no", F.lit(0))
    moved = detections(s, d).join(b, "image_id").withColumns({c: F.col(c) + F.col("confidence") * 0.1 for c in ("x1", "x2")})
    return D.detection_map(moved, gts)


_VOTE = "list_extract(list_sort(list_transform(list_distinct(h), lambda v: {'n': -len(list_filter(h, lambda x: x = v)), 'p': list_position(h, v), 'v': v})), 1)['v']"


@query("smoothed_labels", (
    f"SELECT stream_id, event_id, COALESCE(CASE WHEN len(h) > 0 THEN {_VOTE} END, '') AS smoothed FROM (SELECT stream_id, event_id, "
    f"list_filter(list(class_name) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), "
    f"lambda x: x IS NOT NULL) AS h FROM frames)"
))
def _(s, d):
    return R.smooth_labels(frames(s, d), order=["ts", "event_id"]).select("stream_id", "event_id", "smoothed")


@query("frame_rate", "SELECT stream_id, time_bucket(INTERVAL 500 MILLISECONDS, ts) AS start, COUNT(*) AS n, COUNT(*) / 0.5::DOUBLE AS fps FROM frames GROUP BY 1, 2")
def _(s, d):
    return R.frame_rate(frames(s, d))


#: A row a step: whether it is kept, and the time of the last one kept.
_KEPT = """
WITH placed AS (SELECT stream_id, event_id, ts, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS pos FROM frames),
pass AS (SELECT stream_id, event_id, ts, pos, ts AS last, true AS kept FROM placed WHERE pos = 1
  UNION ALL SELECT p.stream_id, p.event_id, p.ts, p.pos, CASE WHEN p.ts >= a.last + INTERVAL 1 HOUR THEN p.ts ELSE a.last END, p.ts >= a.last + INTERVAL 1 HOUR FROM pass a JOIN placed p ON p.stream_id = a.stream_id AND p.pos = a.pos + 1)
SELECT stream_id, event_id, ts FROM pass WHERE kept"""


@query("debounced", _KEPT.strip())
def _(s, d):
    return R.debounce(frames(s, d), min_gap=3600.0).select("stream_id", "event_id", "ts")


@query("capture_progress", "SELECT class_name, COUNT(*) AS captured, LEAST(COUNT(*) / 1000::DOUBLE, 1) AS share FROM frames GROUP BY 1", "share")
def _(s, d):
    return R.capture_progress(frames(s, d), 1000)


def live_frames(s, d) -> DataFrame:
    """The frames as a stream of the events table's files."""
    # file streams read folders or patterns
    source = s.readStream.schema(read(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    share = F.col("value") / 500
    return source.select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(share >= 0.1, F.col("event_type")).alias("class_name"), share.alias("confidence"))


def streamed(s, sdf: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream has written when it has read all that is there."""
    path = new_path(s, "stream")
    S.run_to_table(sdf, f"{path}/out", f"{path}/checkpoint", mode)
    return s.read.parquet(f"{path}/out")


def streamed_to_end(s, sdf: DataFrame, work: S.Ordered) -> DataFrame:
    """What the operator has put out over the stream and, as the stream has ended, over the rows that were still waiting."""
    path = new_path(s, "stream")
    S.run_to_table(work.stream(sdf), f"{path}/out", f"{path}/checkpoint", ordered=work)
    return S.written(s, f"{path}/out")


def _sql(name: str) -> str:
    """A query's SQL without the tables, to be used again."""
    return ORACLE_SQL[name].removeprefix(f"WITH RECURSIVE {CTES.strip()}").removeprefix(",").strip()


@query("streamed_labels", _sql("smoothed_labels"))
def _(s, d):
    """The stateful operator over a stream of the events table, run to its end."""
    return streamed_to_end(s, live_frames(s, d).drop("confidence"), S.smoothing()).select("stream_id", "event_id", "smoothed")


@query("streamed_rate", (
    "SELECT * FROM (SELECT stream_id, time_bucket(INTERVAL 500 MILLISECONDS, ts) AS start, COUNT(*) AS n, COUNT(*) / 0.5::DOUBLE AS fps "
    "FROM frames GROUP BY 1, 2) WHERE start + INTERVAL 500 MILLISECONDS <= (SELECT MAX(ts) - INTERVAL 10 SECONDS FROM frames)"
))
def _(s, d):
    """Windows that the watermark, ten seconds behind the last frame, has passed."""
    return streamed(s, S.fps_stream(live_frames(s, d)))


@query("streamed_debounce", "WITH " + _sql("debounced"))
def _(s, d):
    sdf = live_frames(s, d)
    return streamed_to_end(s, sdf, S.debouncing(sdf.schema, min_gap=3600.0)).select("stream_id", "event_id", "ts")


@query("streamed_progress", _sql("capture_progress"))
def _(s, d):
    return streamed(s, S.capture_progress(live_frames(s, d), 1000), "complete")


def _panel(s, d) -> tuple[DataFrame, list[str]]:
    """The panel with all features, stored once for the fits, and their names."""
    x = sales.features(s, d)
    cols = X.feature_columns(x)
    return stored(x.select("date", "store_nbr", "family", "sales", *[c for c in cols if c not in ("store_nbr", "family")])), cols


@query("gbt_backtest", "", checked=False)
def _(s, d):
    x, cols = _panel(s, d)
    # the given prices end before the sales: folds end with the last complete row
    return C.backtest_errors(C.backtest(x, B.walk_forward_folds(X.drop_incomplete(x, [*cols, "sales"])), cols))


@query("gbt_forecast", "", checked=False)
def _(s, d):
    x, cols = _panel(s, d)
    x = x.withColumn("id", F.xxhash64("date", "store_nbr", "family"))
    last = x.agg(F.max("date")).first()[0]
    train, test = x.filter(F.col("date") <= F.date_sub(F.lit(last), 16)), x.filter(F.col("date") > F.date_sub(F.lit(last), 16))
    return C.forecast(train, test.withColumn("sales", F.lit(None).cast("double")), cols)


@query("feature_importance", "", checked=False)
def _(s, d):
    x, cols = _panel(s, d)
    return C.feature_importance(C.fit_gbt(X.drop_incomplete(x, [*cols, "sales"]), cols), cols)
