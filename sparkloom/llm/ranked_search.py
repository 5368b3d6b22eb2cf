"""Operator 11: ranked lexical search, term at a time over short lists and document at a time over long ones.

The corpus is indexed in segments: each holds some 16 MB of texts as one row of ids, lengths and posting lists (places of the
documents in the segment, and counts), so that segments are searched apart and nothing is shuffled but their best rows. Per
item and segment the postings of its short lists are summed into accumulators. These are from then on one iterator with a
bound of its own, that is read beside the long lists in order of documents, a stride at a time: the tenth best score known so
far is the threshold; blocks of documents whose bounds don't reach it are passed over; lists whose bounds together stay below
it bring up no document by themselves; documents that the other iterators bring up seek their counts in the remaining lists,
strongest first, until they can't reach the threshold any more. Thresholds go on from segment to segment of a task.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE_BYTES, column, pieces, stored

#: Separators become blanks, A-Z lower case; all other bytes of a term stay.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text in a segment, items in a block of questions, documents in a block and in a stride.
SEGMENT_BYTES, QUERY_BLOCK, BLOCK, STRIDE = 16 << 20, 2048, 64, 1024
#: A list is short if it holds at most one in so many documents of the segment.
SHORT = 16
_SEGMENT = "n_docs long, n_terms long, ids array<bigint>, lengths binary, terms array<binary>, dfs array<int>, places binary, counts binary"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those of about PIECE_BYTES."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and _TERM_BYTES[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_TERM_BYTES).split()
        at = end


def index_segments(docs: DataFrame, terms: list[bytes] | None = None, id_col: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Every document with at least one term, in segments; lists of the given terms only, or of all.

    Lengths count all terms. Null texts have none. Rows are documents for themselves, whether or not ids repeat or are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = defaultdict(count().__next__) if terms is None else {t: i for i, t in enumerate(terms)}
        ids: list[int | None] = []
        lengths: list[int] = []
        keys: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
            # a posting of many long pieces of one text stands in several keys of one value: unique has summed them
            term, place = key >> 32, key & 0xFFFFFFFF
            found, df = np.unique(term, return_counts=True)
            names = terms if terms is not None else list(code)
            row = [pa.array([len(ids)], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(lengths, "<i8").tobytes()], pa.binary()), pa.array([[names[t] for t in found.tolist()]], pa.list_(pa.binary())), pa.array([df.astype(np.int32)], pa.list_(pa.int32())), pa.array([place.astype("<i4").tobytes()], pa.binary()), pa.array([n.astype("<i4").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["n_docs", "n_terms", "ids", "lengths", "terms", "dfs", "places", "counts"])

        for batch in batches:
            for part, data in pieces(batch, "text"):
                for i, x in zip(column(part, "doc_id").to_pylist(), data, strict=True):
                    n = 0
                    for words in terms_of(x):
                        n += len(words)
                        codes = np.fromiter(map(code.__getitem__, words) if terms is None else map(code.get, words, repeat(-1)), np.int64, len(words))
                        keys.append((codes[codes >= 0] << 32) | len(ids))
                    if n:
                        ids.append(i)
                        lengths.append(n)
                    size += len(x)
                    if size >= segment_bytes:
                        if ids:
                            yield segment()
                        ids, lengths, keys, size = [], [], [], 0
                        if terms is None:
                            code.clear()
                            code.default_factory = count().__next__
        if ids:
            yield segment()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _SEGMENT)


class Best:
    """The k best rows of an item so far: highest score first, equal scores by ascending id, rows without an id last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        self.score, self.id, self.known = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.known, known])
        keep = np.lexsort((self.id, ~self.known, -self.score))[: self.k]
        self.score, self.id, self.known = self.score[keep], self.id[keep], self.known[keep]

    @property
    def threshold(self) -> int:
        """Least score that may still enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


class Segment:
    """A segment's lists of the asked terms, with what each posting adds to a score."""

    def __init__(self, row: dict, weight: dict[bytes, int], n_docs: int, n_terms: int):
        self.size = row["n_docs"]
        self.known = np.array([i is not None for i in row["ids"]])
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        slope = 8 * (10 + 90 * np.frombuffer(row["lengths"], "<i8") * n_docs // n_terms)
        end = np.cumsum(np.array(row["dfs"], np.int64))
        place, tf = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["counts"], "<i4")
        asked = [(t, e - n, e) for t, n, e in zip(row["terms"], row["dfs"], end.tolist(), strict=True) if t in weight]
        self.lists: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for t, a, b in asked:
            n = tf[a:b].astype(np.int64)
            self.lists[t] = place[a:b], weight[t] * (1_000_000_000 * n // (1000 * n + slope[place[a:b]]))
        self.short = {t for t, (p, _) in self.lists.items() if len(p) * SHORT <= self.size}
        self.blocks = -(-self.size // BLOCK)
        long = [t for t in self.lists if t not in self.short]
        self.row = {t: i for i, t in enumerate(long)}
        #: The most that a long list adds in a block of documents.
        self.most = np.zeros((len(long), self.blocks), np.int64)
        for t, i in self.row.items():
            p, c = self.lists[t]
            begin = np.flatnonzero(np.diff(p // BLOCK, prepend=-1))
            self.most[i, p[begin] // BLOCK] = np.maximum.reduceat(c, begin)
        self.read = 0

    def search(self, terms: list[bytes], best: Best) -> None:
        """Add this segment's documents to the best rows of an item."""
        here = [t for t in terms if t in self.lists]
        summed = np.zeros(self.size, np.int64)
        for t in here:
            if t in self.short:
                p, c = self.lists[t]
                summed[p] += c
                self.read += len(p)
        held = np.flatnonzero(summed)
        least = best.threshold
        if len(held) >= best.k:
            least = max(least, int(np.partition(summed[held], -best.k)[-best.k]))
        long = sorted((t for t in here if t in self.row), key=lambda t: -int(self.most[self.row[t]].max()))
        rows = [self.row[t] for t in long]
        bound = np.maximum.reduceat(summed, np.arange(0, self.size, BLOCK)) + self.most[rows].sum(0)
        # of the long lists from the i-th strongest on
        rest = np.append(np.cumsum(self.most[rows].max(1)[::-1])[::-1], 0) if rows else np.zeros(1, np.int64)
        for begin in range(0, self.size, STRIDE):
            blocks = np.arange(begin // BLOCK, min((begin + STRIDE) // BLOCK, self.blocks))
            blocks = blocks[bound[blocks] >= least]
            if not len(blocks):
                continue
            # the accumulators and the essential lists bring up documents; what the others hold alone is below the threshold
            lead = int(np.searchsorted(-rest, -least, "right"))
            up = [held[np.searchsorted(held, begin) : np.searchsorted(held, begin + STRIDE)]]
            for t in long[:lead]:
                p = self.lists[t][0]
                up.append(p[np.searchsorted(p, begin) : np.searchsorted(p, begin + STRIDE)])
                self.read += len(up[-1])
            docs = np.unique(np.concatenate(up)) if lead else up[0]
            docs = docs[bound[docs // BLOCK] >= least]
            score = summed[docs]
            for i, t in enumerate(long):
                hopeful = score + rest[i] >= least
                docs, score = docs[hopeful], score[hopeful]
                if not len(docs):
                    break
                p, c = self.lists[t]
                at = np.searchsorted(p, docs)
                at[at == len(p)] = 0
                score = score + np.where(p[at] == docs, c[at], 0)
                self.read += len(docs) if i >= lead else 0
            enough = score >= least
            if enough.any():
                docs, score = docs[enough], score[enough]
                best.add(score, self.ids[docs], self.known[docs])
                least = max(least, best.threshold)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", query_block: int = QUERY_BLOCK, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score, by integer BM25-like scores.

    Rows of one item_id are one item, each term counts once; items without id or terms have no rows, nor have documents whose score
    is 0 (so empty tables give none). Null texts have no terms; null doc_ids rank behind equal scores; each row of repeated ids
    stands for itself. Items are searched in blocks of ``query_block``; lists of other than their terms are indexed only if there
    is more than one block. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    kind = asked.schema["item_id"].dataType
    result = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    blocks = max(1, -(-asked.count() // query_block))
    found, segments = None, None
    for block in range(blocks):
        wanted: dict[object, set[bytes]] = {}
        for i, x in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():  # of a bounded number of items
            wanted.setdefault(i, set()).update(t for words in terms_of(x.encode()) for t in words)
        names = sorted(set().union(*wanted.values()))
        if not names:
            continue
        if segments is None:
            segments = stored(index_segments(docs, names if blocks == 1 else None, id_col, text, segment_bytes))
            n_docs, n_terms = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
            if not n_docs:
                break
        lists = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("list")).select(F.col("list.terms").alias("term"), F.col("list.dfs").alias("df"))
        if blocks > 1:
            lists = lists.join(F.broadcast(spark.createDataFrame([(bytearray(t),) for t in names], "term binary")), "term", "left_semi")
        weight = {bytes(t): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in lists.groupBy("term").agg(F.sum("df")).collect()}
        local = _search(segments, list(wanted), [sorted(t) for t in wanted.values()], weight, n_docs, n_terms, k)
        local = local.join(F.broadcast(spark.createDataFrame([(n, i) for n, i in enumerate(wanted)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))), "item")
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        found = ranked if found is None else found.unionByName(ranked)
    return spark.createDataFrame([], result) if found is None else found


def _search(segments: DataFrame, items: list, terms: list[list[bytes]], weight: dict[bytes, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best rows of each item of the block in each task."""
    sent = segments.sparkSession.sparkContext.broadcast((terms, {t: w for t, w in weight.items() if w > 0}))  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = sent.value
        best = [Best(k) for _ in terms]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0], weight, n_docs, n_terms)
                for t, b in zip(terms, best, strict=True):
                    segment.search(t, b)
        for item, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), item, np.int32)), pa.array(b.id, mask=~b.known), pa.array(b.score)], ["item", "doc_id", "score"])

    return segments.mapInArrow(run, "item int, doc_id long, score long")
