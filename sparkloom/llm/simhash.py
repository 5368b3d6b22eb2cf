"""Operator 3: SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most ``bits`` bits differ in at most so many of their 8 bytes, so they share at least
8 - bits positional bytes. Single bytes have only 2048 postings, whose lists grow with the corpus; postings are therefore
keyed by three positional bytes at once, all triples within bytes 0-3 and within bytes 4-7. Of any five shared positions three
lie in one half, so no pair is lost, and a posting list holds about 1/2^24 of the fingerprints. Per pair in a posting the shared
positional bytes are tallied; pairs that reach the guaranteed minimum are verified by the bits that differ.

Equal fingerprints are one index entry from the start (groups of copies are never paired). A posting list is cut into blocks
of at most ``block`` entries and block meets block, so that no list is held by one task; of each meeting only a spanning forest of
the links found leaves the task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces, stored
from .components import connected_components

_CHUNK = 1 << 16


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """SimHash of a word sequence: bit set if more than half of its shingles' XXH64 (seed 42) have it. No words: 0."""
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    if len(words) < width:
        shingles = [b" ".join(words)]
    elif width == 3:
        shingles = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:])]
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(n)]
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _CHUNK):
        h = np.array([digest(s, 42) for s in shingles[i : i + _CHUNK]], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: str, text: str, width: int = 3) -> DataFrame:
    """(``keep``, fp: the fingerprint as a signed long) per row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in pieces(batch, "text"):
                fp = np.array([fingerprint(x.lower().split(), width) for x in data], np.uint64)
                yield pa.RecordBatch.from_arrays([column(part, keep), pa.array(fp.view(np.int64))], [keep, "fp"])

    return docs.select(F.col(keep).cast("long").alias(keep), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{keep} long, fp long")


def _triples() -> list[tuple[int, ...]]:
    return [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]


def _forest(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> tuple[list[int], list[int]]:
    """Of links a[i]-b[i] between entries, those that join two trees."""
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    left, right = [], []
    for x, y in zip(fa[a].tolist(), fb[b].tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            left.append(x)
            right.append(y)
    return left, right


def links(fps: DataFrame, bits: int = 3, block: int = 512) -> DataFrame:
    """(a, b) pairs of distinct fingerprints (column fp) whose links connect exactly what all links within ``bits`` connect. bits: 0 to 3."""
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees a shared triple for up to 3 differing bits")
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = F.array(*[F.lit(k << 24).bitwiseOR(F.shiftleft(byte(x), 16)).bitwiseOR(F.shiftleft(byte(y), 8)).bitwiseOR(byte(z)) for k, (x, y, z) in enumerate(_triples())])
    postings = fps.select("fp", F.explode(keys).alias("key"))
    # a key's list is cut by a hash of the entry into as many blocks as it needs; single entries meet nobody
    size = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    cut = postings.join(size, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    meet = cut.select("fp", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meet = meet.select("fp", "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") <= F.col("other")).alias("first"), (F.col("mine") >= F.col("other")).alias("second"))

    def pair(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted postings: the entries of one meeting stand together."""
        rest = None
        for pdf in rows:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            k = pdf[["key", "x", "y"]].to_numpy()
            new = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            if not len(new):
                rest = pdf
                continue
            rest = pdf.iloc[new[-1] :].reset_index(drop=True)
            yield meetings(pdf.iloc[: new[-1]], np.concatenate([[0], new]))
        if rest is not None and len(rest):
            k = rest[["key", "x", "y"]].to_numpy()
            yield meetings(rest, np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(rest)]]))

    def meetings(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        fp, first, second = pdf["fp"].to_numpy().view(np.uint64), pdf["first"].to_numpy(), pdf["second"].to_numpy()
        left: list[int] = []
        right: list[int] = []
        size = np.diff(cuts)
        twos = cuts[:-1][size == 2]  # most lists
        if len(twos):
            hit = twos[close(fp[twos], fp[twos + 1])]
            left += fp[hit].view(np.int64).tolist()
            right += fp[hit + 1].view(np.int64).tolist()
        for i, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            f = fp[i : i + n]
            a, b = f[first[i : i + n]], f[second[i : i + n]]
            x, y = np.nonzero(close(a[:, None], b[None, :]))
            x, y = _forest(x, y, a.view(np.int64), b.view(np.int64))
            left += x
            right += y
        return pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a ^ b
        shared = np.zeros(d.shape, np.uint8)
        for i in range(8):
            shared += (d >> np.uint64(8 * i)) & np.uint64(255) == 0
        # count filter, then the exact test
        return (shared >= 8 - bits) & (np.bitwise_count(d) <= bits)

    dealt = meet.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInPandas(pair, "a long, b long").filter("a <> b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id) of every row; component_id is the smallest id reachable by links.

    Null and empty texts have fingerprint 0 and link like any other. Null ids are returned with their component, but never
    name one (a component of null ids alone has a null id); equal rows each give a row. Other columns are not read.
    """
    # links are between fingerprints, so the ids take no part in the index
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    of = stored(fingerprints(own, "doc_id", "text", width))
    fps = of.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(fps, bits))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = of.join(named.join(smallest, "root").select("fp", "component_id"), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
