"""Keyword index of block-max segments, and BM25 search that skips blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, keyword_tokens
from ..session import stored_small

#: Folders of saved postings.
BUCKETS = 32
#: Chunks and tokens of a segment, chunks of a block, blocks of a step of the search, questions that are searched at once.
SEGMENT_CHUNKS, SEGMENT_TOKENS, BLOCK, STEP, QUERY_BLOCK = 8192, 1_000_000, 8, 256, 4096
#: Chunks of a segment up to which whole lists are added up, which takes an array operation a term; blocks are skipped in longer ones.
WHOLE = 65_536
#: Postings of a batch of the table of postings, chunks that are handed to a worker at once.
POSTINGS, CHUNKS = 65_536, "1024"
#: A segment is a row of megabytes: each is a row group of its own and a batch of its own.
_ROW = {"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}
_ONE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
_LIST = "struct<term:string,places:array<int>,tfs:array<int>,block:array<int>,most_tf:array<int>,least_dl:array<int>>"
_SEGMENT = f"segment string, chunk_ids array<string>, chunk_ords array<bigint>, dls array<int>, terms array<string>, dfs array<int>, lists array<{_LIST}>"


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class KeywordIndex:
    """Immutable segments of chunks. Of each term a segment has the places and counts of its chunks, and of each block of places the largest count and the least length.

    Segments of other corpora can be added, chunks can be removed (``removed``: chunk_id); all statistics are those of the chunks that stay.
    """

    segments: DataFrame
    removed: DataFrame | None = None

    def present(self) -> DataFrame:
        """The segments with ``gone``: the places of removed chunks."""
        if self.removed is None:
            return self.segments.withColumn("gone", F.array().cast("array<int>"))
        held = self.segments.select("segment", F.posexplode("chunk_ids").alias("place", "chunk_id"))
        gone = held.join(self.removed.select("chunk_id").distinct(), "chunk_id").groupBy("segment").agg(F.collect_set("place").alias("gone"))  # of one segment
        return self.segments.join(gone, "segment", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))

    @property
    def corpus(self) -> DataFrame:
        """One row: n, avgdl."""
        left = F.when(F.size("gone") == 0, F.col("dls")).otherwise(F.filter("dls", lambda _, i: ~F.array_contains("gone", i)))
        own = self.present().select(F.size(left).cast("long").alias("n"), F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x).alias("dl"))
        return own.agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"))

    def counts(self) -> DataFrame:
        """term, df. Without removed chunks no list is read."""
        if self.removed is None:
            own = self.segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("l"))
            return own.groupBy(F.col("l.terms").alias("term")).agg(F.sum("l.dfs").alias("df"))
        left = lambda p: F.when(F.size("gone") == 0, F.size(p)).otherwise(F.size(F.array_except(p, "gone")))
        each = self.present().select(F.explode(F.transform("lists", lambda x: F.struct(x["term"].alias("term"), left(x["places"]).alias("df")))).alias("l"))
        return each.filter("l.df > 0").groupBy(F.col("l.term").alias("term")).agg(F.sum("l.df").alias("df"))

    def raw_terms(self, counts: DataFrame | None = None) -> DataFrame:
        return (self.counts() if counts is None else counts).crossJoin(F.broadcast(self.corpus)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))

    def weighed(self, terms: DataFrame | None = None, floor: float = 0.25, counts: DataFrame | None = None) -> DataFrame:
        """term, df, idf, of some terms only if given. An idf below 0 is replaced by ``floor`` times the mean idf of all terms. ``counts``: those of this index, if at hand."""
        raw = self.raw_terms(counts)
        mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))  # one row
        some = raw if terms is None else raw.join(F.broadcast(terms), "term", "left_semi")
        return some.crossJoin(mean).select("term", "df", F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    @property
    def terms(self) -> DataFrame:
        return self.weighed()

    @property
    def postings(self) -> DataFrame:
        """term, chunk_id, chunk_ord, dl, tf."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    chunk_ids, ords, dls, lists, gone = (batch.column(i)[row].values for i in range(5))
                    term, places, tfs = (lists.field(i) for i in range(3))
                    every, counts = places.flatten(), tfs.flatten()
                    of = np.repeat(np.arange(len(term), dtype=np.int32), pa.compute.list_value_length(places).to_numpy())
                    for begin in range(0, len(every), POSTINGS):
                        at = every.slice(begin, POSTINGS)
                        rows = pa.RecordBatch.from_arrays([term.take(pa.array(of[begin : begin + POSTINGS])), chunk_ids.take(at), ords.take(at), dls.take(at), counts.slice(begin, POSTINGS).cast(pa.int64())], ["term", "chunk_id", "chunk_ord", "dl", "tf"])
                        yield rows.filter(pa.compute.invert(pa.compute.is_in(at, gone))) if len(gone) else rows

        return self.present().select("chunk_ids", "chunk_ords", "dls", "lists", "gone").mapInArrow(run, "term string, chunk_id string, chunk_ord long, dl int, tf long")

    def with_segments(self, other: KeywordIndex) -> KeywordIndex:
        """This index and the segments of another one; answers are those of an index of both corpora. What either has removed stays removed."""
        gone = [x for x in (self.removed, other.removed) if x is not None]
        return KeywordIndex(self.segments.unionByName(other.segments), gone[0].select("chunk_id").union(gone[1].select("chunk_id")) if len(gone) == 2 else gone[0] if gone else None)

    def without(self, chunk_ids: DataFrame) -> KeywordIndex:
        """This index without some chunks (chunk_id), which are passed over until segments are built anew."""
        ids = chunk_ids.select("chunk_id")
        return KeywordIndex(self.segments, ids if self.removed is None else self.removed.select("chunk_id").union(ids))


def _segment(chunks: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One segment of chunks with tokens."""
    ids, ords, tokens = (pa.chunked_array([b.column(i) for b in chunks]).combine_chunks() for i in range(3))
    order = pa.compute.array_sort_indices(pa.compute.list_value_length(tokens))  # chunks of like length share blocks, whose bounds are then close
    ids, ords, tokens = ids.take(order), ords.take(order), tokens.take(order)
    dl = pa.compute.list_value_length(tokens).to_numpy().astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) << 32 | np.repeat(np.arange(len(dl)), dl), return_counts=True)
    term, place = key >> 32, key & 0xFFFFFFFF
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    block = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(place // BLOCK, prepend=-1))
    in_list = np.searchsorted(block, np.append(begin, len(key)))

    def cut(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))

    most, least = (np.maximum.reduceat(tf, block), np.minimum.reduceat(dl[place], block)) if len(block) else (tf, tf)
    ends = np.append(begin, len(key))
    fields = [words.dictionary.take(pa.array(term[begin])), cut(ends, place), cut(ends, tf), cut(in_list, place[block] // BLOCK), cut(in_list, most), cut(in_list, least)]
    dfs = pa.array(np.diff(ends).astype(np.int32))
    lists = pa.StructArray.from_arrays(fields, ["term", "places", "tfs", "block", "most_tf", "least_dl"])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), one(ids), one(ords), one(pa.array(dl.astype(np.int32))), one(fields[0]), one(dfs), one(lists)], ["segment", "chunk_ids", "chunk_ords", "dls", "terms", "dfs", "lists"])


def bm25_index(chunks: DataFrame, stopwords: list[str] = STOPWORDS) -> KeywordIndex:
    """Segments of (chunk_id, chunk_ord, text), in the order in which partitions hold them, stored in the shared folder. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = tokens = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                held.append(part)
                n += part.num_rows
                tokens += len(part.column(2).flatten())
                if n >= SEGMENT_CHUNKS or tokens >= SEGMENT_TOKENS:
                    yield _segment(held)
                    held, n, tokens = [], 0, 0
        if held:
            yield _segment(held)

    tokens = F.coalesce(keyword_tokens(F.col("text"), stopwords), F.array().cast("array<string>"))
    return KeywordIndex(stored_small(chunks.select("chunk_id", F.col("chunk_ord").cast("long"), tokens.alias("t")).mapInArrow(run, _SEGMENT), {"spark.sql.execution.arrow.maxRecordsPerBatch": CHUNKS}, **_ROW))


def document_counts(chunks: DataFrame, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """term, df of (text) chunks, as an index of them would tell, without one."""
    terms = chunks.select(F.explode(F.array_distinct(keyword_tokens(F.col("text"), stopwords))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def summed(row: dict[str, pa.Array], asked: list[dict[str, float]], least: list[float], k: int, impact) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each question (weights of terms) the places and scores of a segment's chunks that may be among the best k: those of ``least`` at least, at most k.

    Whole lists are added up, a term at a time.
    """
    dl, ords, lists = row["dls"].to_numpy(), row["chunk_ords"].to_numpy(), row["lists"]
    gone = row["gone"].to_numpy()
    term, places, tfs = (lists.field(i) for i in range(3))
    ends, at, tf = places.offsets.to_numpy(), places.values.to_numpy(), tfs.values.to_numpy()
    words = pa.array(sorted({t for ts in asked for t in ts}), pa.string())
    found = np.flatnonzero(pa.compute.is_in(term, words).to_numpy(zero_copy_only=False))
    own = {}
    for i, t in zip(found.tolist(), term.take(pa.array(found)).to_pylist(), strict=True):
        where = at[ends[i] : ends[i + 1]]
        own[t] = where, impact(tf[ends[i] : ends[i + 1]], dl[where])
    score = np.zeros(len(dl))
    for weights, bound in zip(asked, least, strict=True):
        here = [t for t in weights if t in own]
        if not here:
            yield np.empty(0, np.int64), np.empty(0)
            continue
        score[:] = 0
        for t in here:
            where, each = own[t]
            score[where] += weights[t] * each
        score[gone] = 0
        best = np.flatnonzero((score > 0) & (score >= bound))
        if len(best) > k:
            best = best[score[best] >= np.partition(score[best], len(best) - k)[len(best) - k] - 1e-6]  # scores are compared with six places
            best = best[np.lexsort((ords[best], -np.round(score[best], 6)))[:k]]
        yield best, score[best]


class Lists:
    """A segment's lists of the asked terms. ``read`` counts the postings that a search has looked at."""

    def __init__(self, row: dict[str, pa.Array], asked: set[str], impact):
        self.ids, self.ords, self.impact = row["chunk_ids"], row["chunk_ords"].to_numpy(), impact
        self.dl = row["dls"].to_numpy()
        self.gone = np.zeros(len(self.dl), bool)
        self.gone[row["gone"].to_numpy()] = True
        self.blocks = -(-len(self.dl) // BLOCK)
        self.read = 0
        self.lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        #: The largest impact of a term in each block, before its weight.
        self.most: dict[str, np.ndarray] = {}
        self.most_tf: dict[str, np.ndarray] = {}
        struct = row["lists"]
        wanted = np.flatnonzero(pa.compute.is_in(struct.field("term"), pa.array(sorted(asked), pa.string())).to_numpy(zero_copy_only=False))
        for i in wanted.tolist():
            term, places, tfs, block, tf, dl = (struct.field(f)[i] for f in range(6))
            self.lists[term.as_py()] = places.values.to_numpy(), tfs.values.to_numpy()
            most, most_tf = np.zeros(self.blocks), np.zeros(self.blocks)
            most[block.values.to_numpy()] = impact(tf.values.to_numpy(), dl.values.to_numpy())
            most_tf[block.values.to_numpy()] = tf.values.to_numpy()
            self.most[term.as_py()], self.most_tf[term.as_py()] = most, most_tf

    def best(self, weights: dict[str, float], k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of chunks that may be among the best k, of which ``least`` is known to be the k-th score at least."""
        here = sorted((t for t in weights if t in self.lists), key=lambda t: -weights[t] * self.most[t].max())
        if not here:
            return np.empty(0, np.int64), np.empty(0)
        bound = np.array([max(weights[t], 0) * self.most[t] for t in here])
        rest = np.vstack([np.cumsum(bound[::-1], axis=0)[::-1], np.zeros(self.blocks)])  # of the lists from the i-th on
        order = np.argsort(-rest[0], kind="stable")
        found, scores = np.empty(0, np.int64), np.empty(0)
        begin, step = 0, 1
        while begin < self.blocks:  # small steps first: they raise the threshold
            blocks = np.sort(order[begin : begin + step])
            begin, step = begin + step, min(2 * step, STEP)
            blocks = blocks[(rest[0, blocks] >= least) & (rest[0, blocks] > 0)]
            if not len(blocks):
                break
            lead = max(1, int((rest[:-1, blocks].max(1) >= least).sum()))  # chunks of other lists alone stay below
            up = [self._within(t, blocks[rest[i, blocks] >= least]) for i, t in enumerate(here[:lead])]
            self.read += sum(map(len, up))
            docs = np.unique(np.concatenate(up))
            docs = docs[~self.gone[docs]]
            score = np.zeros(len(docs))
            # a chunk's own length bounds what it gets from the counts of its block
            most = np.array([max(weights[t], 0) * self.impact(self.most_tf[t][docs // BLOCK], self.dl[docs]) for t in here])
            left, still = np.arange(len(docs)), most.sum(0)
            for i, t in enumerate(here):
                hopeful = score + still >= least - 1e-9
                docs, score, left, still = docs[hopeful], score[hopeful], left[hopeful], still[hopeful]
                if not len(docs):
                    break
                still = still - most[i, left]
                places, tfs = self.lists[t]
                may = np.flatnonzero(self.most_tf[t][docs // BLOCK])  # blocks without the term aren't looked at
                at = np.searchsorted(places, docs[may])
                at[at == len(places)] = 0
                hit = places[at] == docs[may]
                score[may[hit]] += weights[t] * self.impact(tfs[at[hit]], self.dl[docs[may[hit]]])
                self.read += len(may) if i >= lead else 0
            found, scores = np.concatenate([found, docs]), np.concatenate([scores, score])
            if len(found) > k:
                keep = np.lexsort((self.ords[found], -np.round(scores, 6)))[:k]
                found, scores = found[keep], scores[keep]
            if len(found) >= k:
                least = max(least, scores.min() - 1e-6)  # scores are compared with six places
        return found, scores

    def _within(self, term: str, blocks: np.ndarray) -> np.ndarray:
        """The term's places in some blocks."""
        places = self.lists[term][0]
        begin, end = np.searchsorted(places, blocks * BLOCK), np.searchsorted(places, (blocks + 1) * BLOCK)
        size = end - begin
        return places[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]


def bm25_search(index: KeywordIndex, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(query_id, rank, chunk_id, chunk_ord, score): the best ``k`` chunks of each question by BM25, of these the scores above 0.

    A term that a question repeats counts each time. Ties go to the chunk that comes first. Segments are searched apart, one in memory at
    a time: of those up to WHOLE chunks the lists of a question's terms are added up, of longer ones blocks of chunks are looked at in order
    of what their largest impacts could add up to, until that is below the k-th score so far. That score goes on from segment to segment
    of a task. Questions are sent to all tasks, QUERY_BLOCK at a time; only each segment's best k are kept.
    """
    found = None
    counts = stored_small(index.counts())
    for dealt in _question_blocks(queries.select("query_id", keyword_tokens(F.col("question"), stopwords).alias("t"))):
        part = _search(index, counts, dealt, queries, k, k1, b)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_ord")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked.filter((F.col("rank") <= k) & (F.col("score") > 0)).select("query_id", "rank", "chunk_id", "chunk_ord", "score")


def _question_blocks(asked: DataFrame) -> Iterator[dict]:
    """Questions with the counts of their terms, so many at a time."""
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    for i in range(blocks):
        dealt: dict = {}
        for q, tokens in asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect():
            for t in tokens or []:
                dealt.setdefault(q, {}).setdefault(t, 0)
                dealt[q][t] += 1
        yield dealt


def _search(index: KeywordIndex, counts: DataFrame, dealt: dict, queries: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    spark = queries.sparkSession
    terms = sorted({t for ts in dealt.values() for t in ts})
    idf = {r.term: r.idf for r in index.weighed(spark.createDataFrame([(t,) for t in terms], "term string"), counts=counts).collect()} if terms else {}
    average = index.corpus.first().avgdl or 1.0
    ids = list(dealt)
    sent = spark.sparkContext.broadcast([{t: n * idf[t] for t, n in ts.items() if t in idf} for ts in dealt.values()])  # of one block of questions

    def impact(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        words = {t for ts in asked for t in ts}
        kept: list[list[float]] = [[] for _ in asked]  # each question's best k scores of the task
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].values for j, n in enumerate(batch.schema.names)}
                bound = lambda q: kept[q][-1] - 1e-6 if len(kept[q]) == k else 0.0
                if len(row["dls"]) <= WHOLE:
                    best = summed(row, asked, [bound(q) for q in range(len(asked))], k, impact)
                else:
                    lists = Lists(row, words, impact)
                    best = (lists.best(weights, k, bound(q)) for q, weights in enumerate(asked))
                held: list[tuple[np.ndarray, ...]] = []
                for q, (at, score) in enumerate(best):
                    if len(at):
                        kept[q] = sorted([*kept[q], *score.tolist()], reverse=True)[:k]
                        held.append((np.full(len(at), q, np.int32), at, score))
                if held:
                    qs, at, score = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(qs), row["chunk_ids"].take(pa.array(at)), row["chunk_ords"].take(pa.array(at)), pa.array(score)], ["q", "chunk_id", "chunk_ord", "score"])

    rows = stored_small(index.present().select("chunk_ids", "chunk_ords", "dls", "lists", "gone").mapInArrow(run, "q int, chunk_id string, chunk_ord long, score double"), _ONE)
    kind = queries.schema["query_id"].dataType.simpleString()
    names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {kind}"))
    return rows.join(names, "q").select("query_id", "chunk_id", "chunk_ord", F.round("score", 6).alias("score"))
