"""Operator 6: quality classifier by regularised quadratic discriminant analysis.

A document is a vector of transformed statistics of its text. Each class has a mean and a covariance shrunk towards the
pooled one and towards its own mean variance; the score is the logistic of the difference of the two Gaussian log-densities
plus the log prior odds. Mahalanobis distances go through the inverse of each class's Cholesky factor, worked out once.
Training needs only counts, sums and products of the vectors, which Spark adds up over all labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fold, pieces, stored

_UPPER, _LOWER, _DIGIT, _MARK = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), b"0123456789", b".,;:?'\"()-"
_SYMBOL = b"#*$%&|<>!=+~^_@{}[]\\/`"
NAMES = ["log_words", "mean_length", "length_spread", "upper", "digits", "marks", "symbols", "symbol_words", "bars", "distinct", "top_word", "next_same", "repeated_pairs", "line_words", "repeated_lines"]


def statistics(data: bytes) -> list[float]:
    """The statistics, each on a scale where a normal text's are about normal. An empty text's are all of no words."""
    words = data.split()
    n, size = len(words), max(1, len(data))
    share = lambda kind: (size - len(data.translate(None, kind))) / size if data else 0.0
    odds = lambda x, unit: float(np.log((x + unit) / (1 - min(x, 1) + unit)))
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    count = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    lines = [x for x in data.split(b"\n") if x.split()]
    ends = sum(1 for w in words if w[-1] in _SYMBOL)
    u = 1 / (n + 20)
    return [
        float(np.log1p(n)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        odds(share(_UPPER), 0.01), odds(share(_DIGIT), 0.01), odds(share(_MARK), 0.01), odds(share(_SYMBOL), 0.01),
        odds(ends / max(1, n), 0.02), odds(count.get(b"|", 0) / max(1, n), 0.02),
        odds(len(count) / max(1, n), u), odds(max(count.values(), default=0) / max(1, n), u),
        odds(sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1), 0.02), odds(1 - pairs / max(1, n - 1) if n > 1 else 0.0, 0.02),
        float(np.log1p(n / max(1, len(lines)))), odds(1 - len(set(lines)) / len(lines) if lines else 0.0, 0.05),
    ]


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, x: the statistics); null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([statistics(x) for x in data], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By class (column y): count, sum and sum of products of x. Each task adds up its rows; the rest is (1 + d + d²) sums a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y, x = column(batch, "y").to_numpy(), np.array(column(batch, "x").to_pylist(), float).reshape(len(batch), -1)
            one = np.column_stack([np.ones(len(x)), x])
            for k in np.unique(y):
                m = one[y == k]
                total[int(k)] = total.get(int(k), 0) + m.T @ m
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * m.size, pa.int32()), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], ["y", "i", "v"])

    out: dict[int, np.ndarray] = {}
    d = len(NAMES) + 1
    for y, i, v in rows.select("y", "x").mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(y, np.zeros(d * d))[i] = v
    return {y: (int(round(m[0])), m.reshape(d, d)[0, 1:], m.reshape(d, d)[1:, 1:]) for y, m in out.items()}


class Discriminant:
    def __init__(self, found: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float, ridge: float):
        d = len(NAMES)
        n = {k: found[k][0] if k in found else 0 for k in (0, 1)}
        total = sum(n.values())
        prior = {k: (n[k] + 1) / (total + 2) for k in n}
        mean = {k: found[k][1] / n[k] if n[k] else np.zeros(d) for k in n}
        scatter = {k: found[k][2] - n[k] * np.outer(mean[k], mean[k]) if n[k] else np.zeros((d, d)) for k in n}
        within = sum(scatter.values()) / max(1, total - 2)
        scale = np.sqrt(np.maximum(np.diag(within), 1e-6))
        within = within / np.outer(scale, scale)
        self.scale = scale
        self.parts = []
        for k in (0, 1):
            own = scatter[k] / max(1, n[k] - 1) / np.outer(scale, scale)
            cov = (1 - pooled) * own + pooled * within
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-3) * np.eye(d)
            lower = np.linalg.cholesky(cov)
            self.parts.append((mean[k] / scale, np.linalg.inv(lower), np.log(np.diag(lower)).sum(), np.log(prior[k])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        log = [-0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - half + prior for mean, inverse, half, prior in self.parts]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -60, 60)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, pooled: float = 0.1, ridge: float = 0.02, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, learnt from labelled rows whose ``fold(id, folds)`` is not 0.

    Null texts count as empty and are scored like any other. Null labels and labels other than 0 and 1 are not used; an id with
    several labels counts once with the largest. Null ids match no label. Without labels all scores are 0.5.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = stored(document_statistics(own))
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)").filter(fold("doc_id", folds) != 0)
    train = known.join(y.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(Discriminant(moments(train), pooled, ridge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(column(batch, "x").to_pylist(), float).reshape(len(batch), len(NAMES))
            s = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return known.withColumn("held_out", fold("doc_id", folds) == 0).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
