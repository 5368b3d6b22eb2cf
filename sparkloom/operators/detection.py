"""Detection data: boxes, splits, confusion reports and average precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import scans

#: Class names by id. Fixed values.
CLASSES = ["A", "B", "C", "D", "E", "L", "V", "Y", "thumbsup", "thumbsdown"]


def class_name(class_id: Column) -> Column:
    names = F.array(*[F.lit(c) for c in CLASSES])
    return F.when(class_id.between(0, len(CLASSES) - 1), F.get(names, class_id)).otherwise("unknown")


def class_id(name: Column) -> Column:
    return F.coalesce(*[F.when(name == c, F.lit(i)) for i, c in enumerate(CLASSES)])


def known_classes(images: DataFrame, strict: bool = False) -> DataFrame:
    """Images (class_name) of known classes, with class_id; by default whatever the case of the letters."""
    name = F.upper("class_name") if strict else F.lower("class_name")
    match = F.coalesce(*[F.when(name == (c if strict else c.lower()), F.lit(i)) for i, c in enumerate(CLASSES)])
    return images.withColumn("class_id", match).filter("class_id is not null")


def boxes_from_landmarks(landmarks: DataFrame, padding: float = 0.08, keys: list[str] = ("image_id",)) -> DataFrame:
    """Padded box around each image's points, clipped to [0, 1], as center and size."""
    lo = lambda c: F.greatest(F.min(c) - padding, F.lit(0.0))
    hi = lambda c: F.least(F.max(c) + padding, F.lit(1.0))
    edges = landmarks.groupBy(*keys).agg(lo("x").alias("x1"), lo("y").alias("y1"), hi("x").alias("x2"), hi("y").alias("y2"))
    return corner_to_center(edges)


def corner_to_center(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({"x_c": (c("x1") + c("x2")) / 2, "y_c": (c("y1") + c("y2")) / 2, "w": c("x2") - c("x1"), "h": c("y2") - c("y1")})


def center_to_pixels(df: DataFrame, width: int, height: int) -> DataFrame:
    """Corners in pixels, cut to whole numbers towards 0."""
    c = F.col
    return df.withColumns({"px1": ((c("x_c") - c("w") / 2) * width).cast("int"), "py1": ((c("y_c") - c("h") / 2) * height).cast("int"), "px2": ((c("x_c") + c("w") / 2) * width).cast("int"), "py2": ((c("y_c") + c("h") / 2) * height).cast("int")})


def fallback_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """A box for each readable image (image_id, status): its own, or one for images without a hand or without a detector.

    status: ok, no_hand, no_detector or unreadable; unreadable images get no row.
    """
    no_hand, no_detector = (F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("x_c", "y_c", "w", "h"), strict=True)]) for x in ((0.5, 0.5, 0.6, 0.8), (0.5, 0.5, 0.7, 0.7)))
    own = boxes.select("image_id", F.struct("x_c", "y_c", "w", "h").alias("_b"))
    box = F.when(F.col("status") == "no_detector", no_detector).otherwise(F.coalesce("_b", no_hand))
    return images.filter("status <> 'unreadable'").join(own, "image_id", "left").withColumn("_box", box).drop("_b").select("*", "_box.*").drop("_box")


def format_labels(df: DataFrame) -> DataFrame:
    """(image_id, line): class and box with six decimals."""
    return df.select("image_id", F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "x_c", "y_c", "w", "h").alias("line"))


def parse_labels(lines: DataFrame, first_only: bool = False) -> DataFrame:
    """(image_id, line) to class and box; lines without exactly five fields are left out. ``first_only``: the first line (line_no) of an image."""
    parts = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    rows = lines.withColumn("_p", parts)
    if first_only:
        rows = rows.groupBy("image_id").agg(F.min_by("_p", "line_no").alias("_p"))
    rows = rows.filter(F.size("_p") == 5)
    return rows.select("image_id", F.col("_p")[0].cast("int").alias("class_id"), *[F.col("_p")[i + 1].cast("double").alias(n) for i, n in enumerate(("x_c", "y_c", "w", "h"))])


def stratified_split(df: DataFrame, cls: str, fractions: tuple[float, float] = (0.8, 0.1), seed: int = 42, id_col: str = "image_id") -> DataFrame:
    """``df`` with split: the first floor(n * f) of each class by hashed id to train, then val, the rest to test.

    A class is ranked in 4096 ranges of the hash, each by itself, behind the counts of the ranges before it, so that no task holds a class.
    """
    rows = df.withColumn("_h", F.xxhash64(F.lit(seed), id_col)).withColumn("_range", F.shiftright("_h", 52))
    ranges = rows.groupBy(cls, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(cls)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col(cls).alias("_c"), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_n").over(w).alias("_all"))
    placed = rows.join(ranges, F.col(cls).eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(cls, "_range").orderBy("_h", id_col))
    train, val = F.floor(F.col("_all") * fractions[0]), F.floor(F.col("_all") * fractions[1])
    return placed.withColumn("split", F.when(place <= train, "train").when(place <= train + val, "val").otherwise("test")).drop("_h", "_range", "_c", "_r", "_before", "_all")


def annotation_stats(df: DataFrame) -> DataFrame:
    s = F.col("status")
    return df.agg(F.count_if(s.isin("ok", "no_hand", "no_detector")).alias("processed"), F.count_if(s == "no_hand").alias("no_hand"), F.count_if(s == "unreadable").alias("errors"))


def class_distribution(df: DataFrame, cls: str = "class_id") -> DataFrame:
    return df.groupBy(cls, "split").agg(F.count("*").alias("n"))


def check_minimum(df: DataFrame, classes: DataFrame, per_class: int = 20, cls: str = "class_id") -> DataFrame:
    """(class, n, enough, total_enough) of every class, those without images too."""
    n = classes.select(cls).join(df.groupBy(cls).agg(F.count("*").alias("n")), cls, "left").na.fill(0, ["n"])
    every = Window.partitionBy()
    return n.withColumns({"enough": F.col("n") >= per_class, "total_enough": F.sum("n").over(every) >= F.count("*").over(every) * per_class})


def filter_detections(df: DataFrame, confidence: float = 0.25) -> DataFrame:
    """Detections of at least this confidence."""
    return df.filter(F.col("confidence") >= confidence)


def top_detection(df: DataFrame) -> DataFrame:
    """The most confident detection of each image, of equals the first."""
    best = F.struct("confidence", -F.col("det_no"))
    return df.groupBy("image_id").agg(F.max_by("class_id", best).alias("pred_cls"), F.max("confidence").alias("confidence"))


def pair_predictions(truth: DataFrame, detections: DataFrame, confidence: float = 0.25, count_missed: bool = False) -> DataFrame:
    """(image_id, true_cls, pred_cls). Images without a detection drop out, or count as -1 with ``count_missed``."""
    top = top_detection(filter_detections(detections, confidence)).select("image_id", "pred_cls")
    pairs = truth.select("image_id", F.col("class_id").alias("true_cls")).join(top, "image_id", "left" if count_missed else "inner")
    return pairs.withColumn("pred_cls", F.coalesce("pred_cls", F.lit(-1)))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("true_cls", "pred_cls").agg(F.count("*").alias("n"))


def confusion_table(cm: DataFrame, n_classes: int) -> DataFrame:
    """The matrix with a column for each predicted class."""
    return cm.groupBy("true_cls").pivot("pred_cls", list(range(n_classes))).sum("n").na.fill(0)


def normalize_confusion(cm: DataFrame) -> DataFrame:
    return cm.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true_cls")))


def classification_report(cm: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, precision, recall, f1, support) of every class; 0 where a denominator is 0."""
    support = cm.groupBy(F.col("true_cls").alias("class_id")).agg(F.sum("n").alias("support"))
    called = cm.groupBy(F.col("pred_cls").alias("class_id")).agg(F.sum("n").alias("called"))
    right = cm.filter("true_cls = pred_cls").select(F.col("true_cls").alias("class_id"), F.col("n").alias("right"))
    rows = classes.select("class_id")
    for t in (support, called, right):
        rows = rows.join(t, "class_id", "left")
    rows = rows.na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows = rows.withColumns({"precision": ratio(F.col("right"), F.col("called")), "recall": ratio(F.col("right"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.select("class_id", "precision", "recall", f1.alias("f1"), "support")


def latency_report(df: DataFrame, by: list[str] = ("config",)) -> DataFrame:
    """Mean, interpolated p50, p95 and p99 and rate of latencies (ms), judged at 30 and 100 ms."""
    q = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = df.groupBy(*by).agg(F.avg("ms").alias("mean"), q.alias("q"))
    verdict = F.when(F.col("mean") < 30, "PASS").when(F.col("mean") < 100, "WARN").otherwise("FAIL")
    return out.select(*by, "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), (1000 / F.col("mean")).alias("fps"), verdict.alias("verdict"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes x1, y1, x2, y2 with these column prefixes."""
    c = lambda p, n: F.col(f"{p}{n}")
    over = lambda n: F.greatest(F.least(c(a, f"{n}2"), c(b, f"{n}2")) - F.greatest(c(a, f"{n}1"), c(b, f"{n}1")), F.lit(0.0))
    area = lambda p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1"))
    inter = over("x") * over("y")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def match_boxes(preds: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(image_id, class_id, det_no, confidence, iou_thr, tp): greedy one-to-one matches by falling confidence within image and class.

    Pairs come from an equi-join on image and class, and stream by sorted by image, class and falling confidence: a task holds a batch
    and the boxes that the image and class at hand has given away.
    """
    t = truth.select("image_id", "class_id", F.col("gt_no"), *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    p = preds.select("image_id", "class_id", "det_no", "confidence", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = p.join(t, ["image_id", "class_id"], "left").select(F.col("image_id").cast("long"), F.col("class_id").cast("int"), F.col("det_no").cast("int"), F.col("confidence").cast("double"), "gt_no", F.coalesce(iou("p_", "g_"), F.lit(0.0)).alias("iou"))
    schema = pa.schema([("image_id", pa.int64()), ("class_id", pa.int32()), ("det_no", pa.int32()), ("confidence", pa.float64()), ("iou_thr", pa.float64()), ("tp", pa.bool_())])
    n = len(thresholds)

    def packed(dets: list[tuple], hits: list[bool]) -> pa.RecordBatch:
        each = [pa.array(c, t).take(pa.array(np.repeat(np.arange(len(dets)), n))) for c, t in zip(zip(*dets, strict=True), schema.types[:4], strict=True)]
        return pa.RecordBatch.from_arrays([*each, pa.array(np.tile(np.array(thresholds, np.float64), len(dets))), pa.array(hits, pa.bool_())], schema=schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        det: tuple | None = None
        used: list[set] = []
        hit: list[bool] = []
        for batch in batches:
            dets: list[tuple] = []
            hits: list[bool] = []
            for image, cls, no, conf, gt, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if det != (image, cls, no, conf):
                    if det:
                        dets.append(det)
                        hits += hit
                    if not det or det[:2] != (image, cls):
                        used = [set() for _ in thresholds]
                    det, hit = (image, cls, no, conf), [False] * n
                if gt is not None:
                    for i, thr in enumerate(thresholds):
                        if v < thr:
                            continue
                        if not hit[i] and gt not in used[i]:
                            hit[i] = True
                            used[i].add(gt)
            if dets:
                yield packed(dets, hits)
        if det:
            yield packed([det], hit)

    ordered = pairs.repartition("image_id", "class_id").sortWithinPartitions("image_id", "class_id", F.desc("confidence"), "det_no", F.desc("iou"), "gt_no")
    return ordered.mapInArrow(match, "image_id long, class_id int, det_no int, confidence double, iou_thr double, tp boolean")


def detection_map(preds: DataFrame, truth: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """One row: map50, map50_95 (101-point interpolation), and mean precision and recall at IoU 0.5 over the classes with truth.

    Running counts by falling confidence are scans over ranges of class, threshold and confidence, so no task holds a class; precision is
    made non-increasing from the right by a scan backwards, and read at 101 recalls.
    """
    thresholds = thresholds or [round(float(x), 2) for x in np.arange(0.5, 1.0, 0.05)]
    n = truth.groupBy("class_id").agg(F.count("*").alias("n_gt"))
    keys = ["class_id", "iou_thr"]
    dealt = scans.dealt(match_boxes(preds, truth, thresholds), keys, [F.desc("confidence"), "image_id", "det_no"])
    run = scans.scan(dealt, keys, {"tp_run": ("sum", F.col("tp").cast("int")), "seen": ("sum", F.lit(1))}).join(F.broadcast(n), "class_id")
    curve = stored(run.withColumns({"precision": F.col("tp_run") / F.col("seen"), "recall": F.col("tp_run") / F.col("n_gt")}))
    before = F.when(F.col("seen") > 1, (F.col("tp_run") - F.col("tp").cast("int")) / F.col("n_gt")).otherwise(F.lit(-1.0))
    env = scans.scan(curve, keys, {"best": ("max", "precision")}, ahead=True).withColumn("before", before)
    # recalls r of 0, 0.01 ... 1 that this point is the first to reach
    reached = F.floor(F.round(F.col("recall") * 100, 9)) - F.floor(F.round(F.col("before") * 100, 9))
    reached = F.when(F.col("before") < 0, F.floor(F.round(F.col("recall") * 100, 9)) + 1).otherwise(reached)
    ap = env.groupBy("class_id", "iou_thr").agg((F.sum(F.col("best") * reached) / 101).alias("ap"), F.max_by("precision", "seen").alias("precision"), F.max("recall").alias("recall"))
    grid = n.select("class_id").crossJoin(F.broadcast(truth.sparkSession.createDataFrame([(t,) for t in thresholds], "iou_thr double")))
    full = grid.join(ap, ["class_id", "iou_thr"], "left").na.fill(0.0)
    half = F.col("iou_thr") == thresholds[0]
    return full.agg(F.avg(F.when(half, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"), F.avg(F.when(half, F.col("precision"))).alias("precision"), F.avg(F.when(half, F.col("recall"))).alias("recall"))
