"""Near-duplicates of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from SimHash (op3's index) and from MinHash in 25 bands of 5: a pair of similarity 0.8 shares a band with
probability 1 - (1 - 0.8^5)^25 = 0.99995, one above it more surely. Every link is verified by the shingle sets themselves. Of the
smallest members of its bands a text first meets the ``STARS`` with which it shares most bands; where that leaves a band's members in
several components, pairs across them are verified too. In a small band those are all pairs. Texts of a crowded band also have to share
one of their rarest shingles (of n shingles the n - ceil(0.8 n) + 1 rarest, in an order that is the same for all texts), and what comes
from it on must suffice: a pair whose first common shingle stands at place p of n shingles (from 0) has at most n - p in common, and
similar sets have at least 4/9 of the sum of their sizes. Similar texts always pass; texts that share a notice or a form, or are copies
of one text with words of their own, rarely do. So no candidate pair is left out but those that are connected already or can't be similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, pieces, stored
from .components import connected_components
from .simhash import fingerprints, links

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
_CHUNK = 4096
#: How many of its bands' smallest members a text meets before the components are made.
STARS = 2
#: A band of more texts than this in several components is crowded.
CROWD = 16
#: Shingles are counted by so many hash buckets, which bounds what every task is sent.
BUCKETS = 1 << 16
_MUL = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(43).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; fewer words than a shingle are one; no words: none."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WIDTH:
        return np.array([digest(b" ".join(words))], np.uint64)
    h = np.array([digest(w) for w in words], np.uint64)
    n = len(h) - WIDTH + 1
    out = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        out = (out + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def bands(s: np.ndarray) -> list[int]:
    """One key per band of MinHash values."""
    low = np.full(BANDS * ROWS, ~np.uint64(0), np.uint64)
    for i in range(0, len(s), _CHUNK):
        x = s[i : i + _CHUNK, None] * _MUL + _ADD
        np.minimum(low, (x ^ (x >> np.uint64(32))).min(0), out=low)
    return [xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]


def _per_text(texts: DataFrame, of, kind: str) -> DataFrame:
    """(th, n shingles, x: array of signed longs) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in pieces(batch, "text"):
                sets = [shingles(x) for x in data]
                values = [np.array(of(s), np.uint64).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([column(part, "th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["th", "n", kind])

    return texts.select("th", "text").mapInArrow(run, f"th long, n long, {kind} array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    side = lambda c: sets.select(F.col("th").alias(c), F.col("s").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(both >= SIMILARITY * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets (s) fall into each bucket: at most BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(column(batch, "s").flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    rows = sets.select("s").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def prefixes(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """(th, key, pos) for the rarest shingles of each set (th, s), by its bucket's count and its hash, from place 0 on: any two similar sets have a key in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, places = [], [], []
            for th, values in zip(column(batch, "th").to_pylist(), column(batch, "s"), strict=True):
                x = values.values.to_numpy()
                few = len(x) - math.ceil(SIMILARITY * len(x) - 1e-9) + 1
                keys.append(x[np.lexsort((x, counts[x & (BUCKETS - 1)]))[:few]])
                ids.append(np.full(len(keys[-1]), th, np.int64))
                places.append(np.arange(len(keys[-1])))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys, places)], ["th", "key", "pos"])

    return sets.select("th", "s").mapInArrow(run, "th long, key long, pos long")


def _reach(pos: Column) -> Column:
    """The largest set that one of n shingles can be similar to if the first they share stands at ``pos`` of it: n - pos >= 0.8 / 1.8 * (n + other)."""
    return (F.col("n") - (1 + SIMILARITY) * pos) / SIMILARITY + 1e-6


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts with a key in common, of different components, either's size within the other's reach. rows: key, th, n, root, reach.

    The smaller text of a pair (of equal ones that of the smaller root) meets the other components of its key before it meets their
    texts, so texts that are connected already never meet.
    """
    up = lambda size: (F.col(size) > F.col("na")) | ((F.col(size) == F.col("na")) & (F.col("ra") < F.col("rb")))
    cells = rows.groupBy("key", F.col("root").alias("rb")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("far"))
    a = rows.filter("reach >= n").select("key", F.col("th").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("reach").alias("most"))
    b = rows.select("key", F.col("th").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("reach").alias("far"))
    met = a.join(cells, "key").filter((F.col("ra") != F.col("rb")) & up("high") & (F.col("low") <= F.col("most")) & (F.col("far") >= F.col("na"))).drop("low", "high", "far")
    pairs = met.join(b, ["key", "rb"]).filter(up("nb") & (F.col("nb") <= F.col("most")) & (F.col("far") >= F.col("na")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _in_components(rows: DataFrame) -> DataFrame:
    """Keys (and their number of texts, k) whose texts lie in several components."""
    return rows.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("q"), F.count("*").alias("k")).filter("r <> q").select("key", "k")


def across_components(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that share a band, lie in different components and may be similar. placed: key, th, n, root; sets: th, s."""
    apart = stored(placed.join(_in_components(placed), "key"))
    small = _across(apart.filter(F.col("k") <= CROWD).withColumn("reach", _reach(F.lit(0))))
    crowd = stored(apart.filter(F.col("k") > CROWD).select("th", "n", "root").distinct())
    if crowd.isEmpty():
        return small
    own = stored(sets.select("th", "s").join(crowd, "th", "left_semi"))
    keyed = stored(prefixes(own, bucket_counts(own)).join(crowd, "th").withColumn("reach", _reach(F.col("pos"))).drop("pos"))
    wide = _across(keyed.join(_in_components(keyed).select("key"), "key", "left_semi"))
    return small.unionByName(wide).distinct()


def near_copies(texts: DataFrame) -> DataFrame:
    """(th, root) of the texts (th: the text's hash; text) that have a near-duplicate; root is the component's smallest th."""
    texts = texts.select("th", "text")
    of = stored(_per_text(texts, bands, "keys").dropDuplicates(["th"]))
    fps = stored(fingerprints(texts, "th", "text").dropDuplicates(["th"]))
    entry = fps.groupBy("fp").agg(F.min("th").alias("th"))
    named = lambda c: entry.select(F.col("fp").alias(c), F.col("th").alias(f"t{c}"))
    by_bits = links(entry.select("fp")).distinct().join(named("a"), "a").join(named("b"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    equal = fps.join(entry.withColumnRenamed("th", "a"), "fp").filter("th <> a").select("a", F.col("th").alias("b"))
    keys = of.select("th", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("k"), F.min("th").alias("a")).filter("k > 1")
    members = stored(keys.join(shared.select("key", "a"), "key"))
    met = members.filter("th <> a").groupBy("th", "a").agg(F.count("*").alias("k"))
    most = met.groupBy(F.col("th").alias("b")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "a"))), 1, STARS).alias("x"))
    stars = most.select(F.explode("x.a").alias("a"), "b")
    pairs = stored(stars.unionByName(by_bits).unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).distinct()
    sets = stored(_per_text(texts.join(wanted, "th", "left_semi"), lambda s: s, "s").dropDuplicates(["th"]))
    good = stored(_similar(pairs, sets))
    roots = connected_components(good)
    placed = members.select("key", "th", "n").join(roots.withColumnRenamed("node", "th"), "th", "left").withColumn("root", F.coalesce("root", "th"))
    across = stored(across_components(placed, sets).join(pairs, ["a", "b"], "left_anti"))
    more = _similar(across, sets)
    return connected_components(good.unionByName(more)).select(F.col("node").alias("th"), "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, of equal ids one text. Rows without an id stay.

    Texts without words are one group.
    """
    th = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), th.alias("th"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    groups = near_copies(rows)
    of = rows.filter("doc_id is not null").select("doc_id", "th").distinct().join(groups, "th", "left").withColumn("root", F.coalesce("root", "th"))
    keep = of.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("x"))
    i, t, own = (fresh(docs, n) for n in ("_keep", "_text", "_own"))
    kept = keep.select(F.col("x.doc_id").alias(i), F.col("x.th").alias(t))
    named = docs.filter(F.col(id_col).isNotNull()).withColumn(own, th).join(kept, (F.col(id_col).cast("long") == F.col(i)) & (F.col(own) == F.col(t)), "left_semi")
    return named.dropDuplicates([id_col, own]).drop(own).unionByName(docs.filter(F.col(id_col).isNull()))
