"""Approximate vector search by product quantisation: all codes are scanned, the best few are scored exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .vectors import _unit, knn_exact, top_k

#: Dimensions that share a byte of code, vectors that the books are fitted on, questions that are asked at once, candidates that are pushed down as a list.
TOGETHER, SAMPLE, QUERY_BLOCK, LISTED = 4, 65_536, 1024, 5_000


@dataclass
class CodeIndex:
    """codes (id, code: a byte for each ``TOGETHER`` dimensions), vectors (id, vector, in files sorted by id), and the books that codes point into: parts x 256 x dimensions of a part."""

    codes: DataFrame
    vectors: DataFrame
    books: np.ndarray
    dimensions: int
    n: int

    def read_share(self, rescored: int) -> float:
        """Bytes that a question reads, codes and rescored vectors, by the bytes of all vectors (as 32-bit numbers)."""
        return (self.n * len(self.books) + rescored * 4 * self.dimensions) / max(1, self.n * 4 * self.dimensions)


def _parts(unit: np.ndarray, parts: int) -> np.ndarray:
    """Vectors cut into parts, filled up with zeros: n x parts x dimensions."""
    filled = np.zeros((len(unit), parts * TOGETHER), np.float32)
    filled[:, : unit.shape[1]] = unit
    return filled.reshape(len(unit), parts, TOGETHER)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(1) - 2 * x @ book.T, axis=1)


def _book(x: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """256 centroids of the rows by k-means; surplus ones repeat the first."""
    rng = np.random.default_rng(seed)
    kinds = np.unique(x, axis=0)
    book = kinds[rng.choice(len(kinds), min(256, len(kinds)), replace=False)].copy()
    for _ in range(rounds if len(kinds) > 256 else 0):
        at = _nearest(x, book)
        size = np.bincount(at, minlength=len(book))
        total = np.stack([np.bincount(at, x[:, j], len(book)) for j in range(x.shape[1])], axis=1)
        book[size > 0] = (total[size > 0] / size[size > 0, None]).astype(np.float32)
    return np.concatenate([book, np.repeat(book[:1], 256 - len(book), axis=0)])


def code_index(corpus: DataFrame, rounds: int = 15, sample: int = SAMPLE, seed: int = 7) -> CodeIndex:
    """Codes of (id, vector). Books are fitted on a sample of at most ``sample`` vectors, a task for each part; every row gets its code.

    Vectors are scaled to length 1 (zero vectors stay); all have the dimensions of the first. Null vectors are left out.
    """
    rows = corpus.select("id", F.col("vector").cast("array<float>").alias("vector")).filter("vector IS NOT NULL")
    vectors = stored(rows.repartitionByRange("id").sortWithinPartitions("id"))
    n = vectors.count()
    dimensions = len(first.vector) if (first := vectors.first()) else 1
    parts = -(-dimensions // TOGETHER)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = _parts(_unit(pdf["vector"].tolist()), parts)
                yield pd.DataFrame({"part": np.tile(np.arange(parts, dtype=np.int32), len(pdf)), "x": list(x.reshape(-1, TOGETHER))})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        book = _book(np.stack(pdf["x"].to_numpy()).astype(np.float32), rounds, seed)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "book": [book.ravel().tolist()]})

    some = vectors.orderBy(F.xxhash64("id"), "id").limit(sample)
    fitted = some.mapInPandas(cut, "part int, x array<float>").groupBy("part").applyInPandas(fit, "part int, book array<float>").collect()  # of a bounded sample; a row for each part
    books = np.array([r.book for r in sorted(fitted)], np.float32).reshape(-1, 256, TOGETHER)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                ids, v = batch.slice(begin, 2000).columns
                x = _parts(_unit(v.to_pylist()), parts)
                code = np.stack([_nearest(x[:, p], books[p]) for p in range(parts)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([ids, pa.array([c.tobytes() for c in code], pa.binary())], ["id", "code"])

    codes = stored(vectors.mapInArrow(encode, "id long, code binary"))
    return CodeIndex(codes, vectors, books, dimensions, n)


def knn_codes(index: CodeIndex, queries: DataFrame, k: int = 5, rescored: int | None = None, keep_self: bool = True) -> DataFrame:
    """Approximate ``knn_exact`` by a look at all codes: (query_id, rank, id, score, read_share).

    A code's score is the sum over its parts of a table's entry, the products of a question's part with the part's centroids. The best
    ``rescored`` of each question (by default a sixteenth of the vectors, 512 at most, k at least) are scored by their vectors, so scores
    are exact and only the choice of these is not. Questions are sent to all tasks, QUERY_BLOCK at a time; each task keeps ``rescored``
    rows a question. Where all vectors are rescored codes choose nothing and none is read: each question is scored by every vector as it
    streams by, and k rows a question are kept.
    """
    rescored = max(k + 1, rescored or min(512, -(-index.n // 16)))
    if rescored >= index.n > 0:
        asked = queries.select("query_id", "vector").filter("vector IS NOT NULL")
        return knn_exact(index.vectors, asked, k, keep_self).withColumn("read_share", F.lit(index.read_share(rescored)))
    asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).filter("vector IS NOT NULL")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect() if index.n else []  # of a bounded number of questions
        part = _block(index, [r[0] for r in rows], [r[1] for r in rows], rescored, keep_self)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k).withColumn("read_share", F.lit(index.read_share(rescored)))


def _block(index: CodeIndex, qid: list[int], vectors: list, rescored: int, keep_self: bool) -> DataFrame:
    spark = index.codes.sparkSession
    q = _unit(vectors) if qid else np.zeros((0, index.dimensions))
    parts = len(index.books)
    sent = spark.sparkContext.broadcast((np.array(qid, np.int64), q, _parts(q, parts), index.books))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, _, asked, books = sent.value
        ids, scores = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0), np.float32)
        table = np.einsum("qpd,pcd->qpc", asked, books) if len(qid) else np.zeros((0, parts, 256), np.float32)
        for batch in batches:
            for begin in range(0, batch.num_rows if len(qid) else 0, 4000):
                own, code = batch.slice(begin, 4000).columns
                at = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(-1, parts)
                score = np.zeros((len(qid), len(at)), np.float32)
                for p in range(parts):
                    score += table[:, p, at[:, p]]
                own = own.to_numpy()
                if not keep_self:
                    score[qid[:, None] == own[None, :]] = -np.inf
                ids, scores = np.hstack([ids, np.broadcast_to(own, score.shape)]), np.hstack([scores, score])
                if scores.shape[1] > rescored:
                    best = np.argpartition(-scores, rescored - 1, axis=1)[:, :rescored]
                    ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
        for i, one in enumerate(qid.tolist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(ids.shape[1], one)), pa.array(ids[i]), pa.array(scores[i].astype(np.float64))], ["query_id", "id", "near"])

    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    near = stored(index.codes.mapInArrow(scan, "query_id long, id long, near double").withColumn("r", F.row_number().over(w)).filter((F.col("r") <= rescored) & (F.col("near") > float("-inf"))).select("query_id", "id"))
    wanted = near.select("id").distinct()
    listed = wanted.limit(LISTED + 1).collect()
    # few candidates are looked up in the sorted files by a pushed-down list, many by a join
    vectors = index.vectors.filter(F.col("id").isin([r[0] for r in listed])) if len(listed) <= LISTED else index.vectors

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q, _, _ = sent.value
        place = {x: i for i, x in enumerate(qid.tolist())}
        for pdf in frames:
            if len(pdf):
                exact = np.einsum("nd,nd->n", q[[place[x] for x in pdf["query_id"]]], _unit(pdf["vector"].tolist()))
                yield pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "score": exact})

    return near.join(vectors, "id").select("query_id", "id", "vector").mapInPandas(score, "query_id long, id long, score double")
