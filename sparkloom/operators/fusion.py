"""Fusing ranked lists, reranking, prompts and scores of answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import faithfulness, keyword_recall

#: Ids up to which the wanted chunks are looked up by a broadcast.
WANTED = 100_000
RANKED = ["query_id", "source", "source_order", "rank", "chunk_id"]


def ranked_union(lists: list[tuple[str, DataFrame]]) -> DataFrame:
    """(query_id, source, source_order, rank, chunk_id) of several retrievers' lists, in the order given."""
    out = None
    for i, (name, df) in enumerate(lists):
        part = df.select("query_id", F.lit(name).alias("source"), F.lit(i).alias("source_order"), "rank", "chunk_id")
        out = part if out is None else out.unionByName(part)
    return out


def rrf(ranked: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, source, rrf, rank): reciprocal rank fusion; ties and the source by first appearance."""
    seen = F.struct("source_order", "rank")
    fused = ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.min(seen).alias("seen"), F.min_by("source", seen).alias("source"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "seen")
    return fused.withColumn("rank", F.row_number().over(w)).select("query_id", "chunk_id", "source", "rrf", "rank")


def hydrate(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids with their chunks; unknown ids drop out. Ids are counted: few are sent to the chunks, so that only wanted texts move."""
    ids = ranked.select("chunk_id").distinct()
    if ids.count() <= WANTED:
        chunks = chunks.join(F.broadcast(ids), "chunk_id", "left_semi")
    return ranked.join(chunks.drop("chunk_ord"), "chunk_id")


def rerank(fused: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], list[float]]] | None = None, pool: int = 20, keep: int = 6) -> DataFrame:
    """The best ``keep`` of the fused ``pool`` by a model's score of (question, text), or by the fused order without one.

    ``fused`` has question and text. ``scorer`` makes the model, once in each task.
    """
    top = fused.filter(F.col("rank") <= pool)
    if scorer is None:
        return top.filter(F.col("rank") <= keep).withColumn("rerank", F.lit(None).cast("double"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for pdf in frames:
            yield pdf.assign(rerank=model(pdf["question"].tolist(), pdf["text"].tolist()))

    scored = top.mapInPandas(run, StructType([*top.schema.fields, StructField("rerank", DoubleType())]))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "rank")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def source_counts(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("query_id").pivot("source", ["semantic", "keyword", "graph"]).count().na.fill(0)


#: A prompt's wording: before the passages, each passage, before the question and after it.
PROMPT = {
    "head": "Passages from the collection:\n\n",
    "entry": "({n}) {citation}, found by {source} search\n{text}\n\n",
    "ask": "Question: ",
    "close": "\nAnswer from these passages alone and name those used.",
}


def build_prompts(retrieved: DataFrame, wording: dict[str, str] = PROMPT) -> DataFrame:
    """(query_id, prompt) of rows (query_id, question, rank, citation, source, text): numbered passages, then the question, in the given wording."""
    w = Window.partitionBy("query_id").orderBy("rank")
    parts = re.split(r"\{(n|citation|source|text)\}", wording["entry"])
    entry = F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])
    lines = retrieved.withColumn("n", F.row_number().over(w)).select("query_id", "question", F.struct("n", entry.alias("e")).alias("x"))
    context = lines.groupBy("query_id").agg(F.first("question").alias("question"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), "").alias("context"))
    return context.select("query_id", F.concat(F.lit(wording["head"]), "context", F.lit(wording["ask"]), "question", F.lit(wording["close"])).alias("prompt"))


def citations(retrieved: DataFrame) -> DataFrame:
    return retrieved.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("citation")), "; ").alias("citations"))


def joined_text(retrieved: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, source_text): the texts of the best ``k``, in order."""
    top = retrieved if k is None else retrieved.filter(F.col("rank") <= k)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("source_text"))


def evaluate_retrieval(retrieved: DataFrame, questions: DataFrame, answers: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall, faithfulness) of (query_id, expected_keywords) questions and (query_id, answer) answers."""
    rows = questions.join(answers, "query_id", "left").join(joined_text(retrieved, k).withColumnRenamed("source_text", "top"), "query_id", "left").join(joined_text(retrieved), "query_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("query_id", keyword_recall(text("top"), F.col("expected_keywords")).alias("recall"), faithfulness(text("answer"), text("source_text")).alias("faithfulness"))


def eval_summary(results: DataFrame, by: list[str] = ()) -> DataFrame:
    return results.groupBy(*by).agg(F.avg("recall").alias("recall"), F.avg("faithfulness").alias("faithfulness"), F.count("*").alias("n"))
