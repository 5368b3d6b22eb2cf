"""Vector search: exact by blocks of matrix products, approximate by inverted lists."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import stored_small

#: Questions up to which they are held by every worker; more meet the corpus in blocks.
QUERY_BLOCK = 8192
#: Scores that are worked out at once, vectors that meet the questions at once.
SCORES, VECTORS = 1 << 20, 2048


def l2_normalize(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


class Best:
    """Each question's best k of the vectors seen so far, by rounded score, ties to the smaller id. Scores are worked out SCORES at a time."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, keep_self: bool = True):
        self.qid, self.q, self.k, self.keep_self = qid, q, k, keep_self
        self.ids = np.zeros((len(qid), k), np.int64)
        self.score = np.full((len(qid), k), -np.inf)

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        for s in range(0, len(ids), VECTORS):
            own, part = ids[s : s + VECTORS], m[s : s + VECTORS].T
            step = max(1, SCORES // len(own))
            for b in range(0, len(self.qid), step):
                score = self.q[b : b + step] @ part
                if not self.keep_self:
                    score[self.qid[b : b + step, None] == own[None, :]] = -np.inf
                # a score is compared with six places, so what rounds to the k-th may still count
                row, col = np.nonzero(score >= self.score[b : b + step, -1:] - 1e-6)
                row, col = (x[np.isfinite(score[row, col])] for x in (row, col))
                if not len(row):
                    continue
                hit, place = np.unique(row, return_inverse=True)
                hit, of = hit + b, np.concatenate([np.repeat(np.arange(len(hit)), self.k), place])
                each = np.concatenate([self.ids[hit].ravel(), own[col]])
                value = np.concatenate([self.score[hit].ravel(), score[row, col]])
                order = np.lexsort((each, -np.round(value, 6), of))
                first = np.searchsorted(of[order], np.arange(len(hit)))
                kept = order[first[:, None] + np.arange(self.k)]
                self.ids[hit], self.score[hit] = each[kept], value[kept]

    def frames(self) -> Iterator[pd.DataFrame]:
        for b in range(0, len(self.qid), 2048):
            score = self.score[b : b + 2048].ravel()
            rows = pd.DataFrame({"query_id": np.repeat(self.qid[b : b + 2048], self.k), "id": self.ids[b : b + 2048].ravel(), "score": score})
            yield rows[np.isfinite(score)]


_SCORED = "query_id long, id long, score double"


def knn_exact(corpus: DataFrame, queries: DataFrame, k: int = 5, keep_self: bool = True, block: int = 20_000) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest of (id, vector) for each (query_id, vector) by cosine.

    Questions are sent to all tasks, QUERY_BLOCK at a time; a task keeps k rows a question over all of its vectors, so only those are
    shuffled. More questions take a pass over the corpus each block, whose answers are stored: nothing but time grows with the product
    of both sides. ``keep_self=False`` leaves out the vector whose id is the question's; ``block`` has no effect any more.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    rows = asked.limit(QUERY_BLOCK + 1).collect()
    if len(rows) <= QUERY_BLOCK:
        return _pass(corpus, rows, k, keep_self)
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = None
    for block in range(blocks):
        part = stored_small(_pass(corpus, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect(), k, keep_self))
        found = part if found is None else found.unionByName(part)
    return found


def _pass(corpus: DataFrame, rows: list, k: int, keep_self: bool) -> DataFrame:
    """``knn_exact`` for a bounded number of questions."""
    sent = corpus.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), _unit([r[1] for r in rows]) if rows else None))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = sent.value
        best = Best(qid, q, k, keep_self)
        for pdf in frames:
            for s in range(0, len(pdf) if len(qid) else 0, VECTORS):
                part = pdf.iloc[s : s + VECTORS]
                best.add(part["id"].to_numpy(), _unit(part["vector"].tolist()))
        yield from best.frames()

    return top_k(corpus.select("id", "vector").mapInPandas(search, _SCORED), k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def ivf_build(corpus: DataFrame, nlist: int | None = None, seed: int = 7, iterations: int = 10) -> tuple[DataFrame, np.ndarray]:
    """(corpus with cell_id, centroids): cells by k-means on the unit vectors; by default min(256, a tenth of the rows) cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = corpus.withColumn("_v", array_to_vector(l2_normalize(F.col("vector"))))
    nlist = nlist or max(1, min(256, corpus.count() // 10))
    model = KMeans(featuresCol="_v", predictionCol="cell_id", k=nlist, seed=seed, maxIter=iterations).fit(unit)
    return model.transform(unit).drop("_v"), np.array(model.clusterCenters())


def knn_ivf(cells: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 5, nprobe: int = 1, block: int = 20_000) -> DataFrame:
    """Approximate ``knn_exact``: each question meets the vectors of its ``nprobe`` nearest cells. With all cells it is exact.

    Questions and vectors meet by cell; a cell is dealt out in blocks of about ``block`` vectors, its questions in blocks of about
    QUERY_BLOCK, and all blocks of a cell meet, each meeting in a task's memory of its own. Where all cells are asked nothing is left to
    choose, and vectors aren't moved: it is ``knn_exact``.
    """
    nprobe = min(nprobe, len(centroids))
    if nprobe == len(centroids):
        return knn_exact(cells.select("id", "vector"), queries, k)
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                q = _unit(pdf["vector"].tolist())
                far = ((q[:, None, :] - shared.value[None]) ** 2).sum(2) if len(shared.value) * q.size < 1e8 else -2 * q @ shared.value.T + (shared.value**2).sum(1)
                at = np.argsort(far, axis=1, kind="stable")[:, :nprobe]
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), nprobe), "vector": [v for v in pdf["vector"] for _ in range(nprobe)], "cell_id": at.ravel().astype(np.int32)})

    probes = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(nearest, "query_id long, vector array<double>, cell_id int")
    many = F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))
    size = cells.groupBy("cell_id").count().select("cell_id", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    dealt = cells.join(F.broadcast(size), "cell_id").select("cell_id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), many - 1)).alias("some"), "id", F.col("vector").cast("array<double>").alias("vector"))
    asked = probes.join(F.broadcast(size), "cell_id").select("cell_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), many).cast("int").alias("some"), "query_id", "vector")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        best = Best(q["query_id"].to_numpy(), _unit(q["vector"].tolist()), k)
        best.add(c["id"].to_numpy(), _unit(c["vector"].tolist()))
        return pd.concat(best.frames())

    both = asked.groupBy("cell_id", "part", "some").cogroup(dealt.groupBy("cell_id", "part", "some"))
    return top_k(both.applyInPandas(meet, "query_id long, id long, score double"), k)


def hashing_embedder(dim: int = 256) -> Callable[[list[str]], np.ndarray]:
    """A deterministic model for tests: hashed word counts."""

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                out[i, int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:7], 16) % dim] += 1
        return out

    return model


def embed(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder, batch: int = 64) -> DataFrame:
    """``df`` with a unit ``vector`` of each text. ``load`` makes the model, once in each task; texts go to it in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            texts = pdf[text].tolist()
            rows = [v for i in range(0, len(texts), batch) for v in _unit(model(texts[i : i + batch]))]
            yield pdf.assign(vector=rows)

    return df.mapInPandas(run, StructType([*df.drop("vector").schema.fields, StructField("vector", ArrayType(DoubleType()))]))
