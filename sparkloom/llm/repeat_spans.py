"""Operator 7: removal of repeated byte strings by column-wise construction of sorted prefixes and common lengths.

The published method inserts one symbol of every document each round and keeps the collection's Burrows-Wheeler order and common
prefixes in files that each round reads through. Over whole documents that takes as many rounds, each over all that was
inserted so far, as the longest document has bytes. Here the rounds are bounded: texts are first cut into anchored contexts,
and only contexts that can repeat are built.

1. Anchors: every ``length``-byte window picks the smallest hash among its 64-byte strings. Equal windows pick the same string at
   the same offset, so equal windows meet under one anchor, aligned. An anchor's context is what the windows that picked it span.
2. Equal contexts of an anchor are one row of the construction, with their number; they repeat as a whole. Their 128-bit digests tell,
   so that copies' bytes needn't travel; ``by_bytes`` compares the bytes themselves and stops if two have one digest.
3. The rows of an anchor go through the column-wise construction: each round takes one symbol of every context, re-sorts the
   order stably by it and updates the common lengths of neighbours. A window repeats exactly if its length in common with a
   neighbour in the order reaches ``length``.
4. Anchors with more than ``crowd`` rows (a passage in very many texts) are not held by one task: their windows are counted by hash,
   summed before the shuffle; of blocks of neighbouring windows only those whose common core is counted twice are looked into.

The order, the common lengths and the contexts of a batch of anchors live in one task's memory; between steps everything is in
sorted shuffle files or Parquet, read in sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces, stored

_GRAM = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 18
#: Contexts that are built together, and windows that are counted by their common core first.
_BATCH, _BLOCK = 4096, 24
#: Most document keys that every executor gets to leave out other texts before a shuffle.
BROADCAST_KEYS = 1_000_000

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each 64-byte string of the data, by the bytes' running polynomial."""
    up, down = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    h = (total[_GRAM:] - total[:-_GRAM]) * down[: len(data) - _GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xA24BAED4963EE407)


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: of the end of one block of w and the beginning of the next."""
    n = len(x)
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash) of the anchors of one segment of at most a few MB: windows are those that start in it."""
    h = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    place = (_sliding_least(packed, length - _GRAM + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    return at, first, last, h[at]


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, p, lo, hi, h, g1, g2): an anchor at byte p, the windows [lo, hi] that picked it, its hash, and its context's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in pieces(batch, "text"):
                ids, ths = column(part, "doc_id").to_pylist(), column(part, "th").to_pylist()
                out: list[list] = [[] for _ in range(8)]
                for doc_id, th, raw in zip(ids, ths, data, strict=True):
                    for s in range(0, max(0, len(raw) - length + 1), _SEGMENT):
                        piece = np.frombuffer(raw, np.uint8, min(_SEGMENT + length - 1, len(raw) - s), s)
                        p, lo, hi, h = anchors_of(piece, length)
                        p, lo, hi = p + s, lo + s, hi + s
                        digests = [xxhash.xxh3_128_digest(b"%d " % (a - b) + raw[b : c + length]) for a, b, c in zip(p.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                        g = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                        for c, v in zip(out, ([doc_id] * len(p), [th] * len(p), p, lo, hi, h.view(np.int64), g[:, 0], g[:, 1]), strict=True):
                            c.extend(v if isinstance(v, list) else v.tolist())
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "th", "p", "lo", "hi", "h", "g1", "g2"])

    return docs.mapInArrow(run, "doc_id long, th long, p long, lo long, hi long, h long, g1 long, g2 long")


def repeated_columns(symbols: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Column-wise construction over aligned contexts, one row each; group: rows of one anchor stand together.

    symbols: (rows, columns), -1 where a context has none. Returns marks (rows, columns - length + 1): that the window which begins at
    the column equals the same window of another row of its group. Windows that hold a -1 are never marked.

    Before round k the rows of a group are in the order of their symbols before column k, read backwards; since[i] is where the
    stretch in common with the row above begins. A round sorts them stably by the symbol of column k. Two rows that become
    neighbours have in common what all rows between them had: the largest ``since`` on the way.
    """
    rows, columns = symbols.shape
    marks = np.zeros((rows, columns - length + 1), bool)
    order = np.arange(rows)
    since = np.zeros(rows, np.int64)
    top = np.concatenate([[True], group[1:] != group[:-1]])  # groups keep their places
    filled = np.cumsum(symbols >= 0, axis=1, dtype=np.int32)
    number = np.cumsum(top) * 512
    for k in range(columns):
        s = symbols[order, k]
        new = np.argsort(number + s, kind="stable")
        joined = ~top & (s[new] == np.concatenate([[-2], s[new[:-1]]]))
        at = np.flatnonzero(joined)
        fresh = np.full(rows, k + 1, np.int64)
        near = new[at] == new[at - 1] + 1
        fresh[at[near]] = since[new[at[near]]]
        far = at[~near]
        if len(far):
            # largest since between the rows' old places: [old place above + 1, old place]
            ends = np.empty(2 * len(far), np.int64)
            ends[::2], ends[1::2] = new[far - 1] + 1, new[far] + 1
            fresh[far] = np.maximum.reduceat(np.append(since, 0), ends)[::2]
        order, since = order[new], fresh
        if k + 1 >= length:
            begin = k + 1 - length
            same = ~top & (since <= begin)
            hit = same.copy()
            hit[:-1] |= same[1:]
            r = order[hit]
            whole = filled[r, k] - (filled[r, begin - 1] if begin else 0) == length
            marks[r[whole], begin] = True
    return marks


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def built_spans(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, begin, end) of the repeated stretches of the contexts (doc_id, th, p, lo, h, single, bytes), aligned at their anchors.

    Rows that are not single stand for several places, which repeat as a whole and are known; they only tell what repeats in others.
    """
    reach = length - _GRAM

    def build(part: pd.DataFrame) -> pd.DataFrame:
        data = part["bytes"].tolist()
        lead = (part["p"] - part["lo"]).to_numpy()
        symbols = np.full((len(part), reach + length), -1, np.int16)
        for i, (x, n) in enumerate(zip(data, lead.tolist(), strict=True)):
            symbols[i, reach - n : reach - n + len(x)] = np.frombuffer(x, np.uint8)
        marks = repeated_columns(symbols, part["h"].to_numpy(), length)
        some = np.flatnonzero(marks.any(1) & part["single"].to_numpy(bool))
        ids, ths, p = part["doc_id"].tolist(), part["th"].tolist(), part["p"].tolist()
        rows = [(ids[i], ths[i], p[i] - reach + a, p[i] - reach + b - 1 + length) for i in some.tolist() for a, b in _runs(marks[i])]
        return pd.DataFrame(rows, columns=["doc_id", "th", "begin", "end"]).astype({"th": "int64", "begin": "int64", "end": "int64", "doc_id": "Int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            held.append(pdf)
            if sum(map(len, held)) < _BATCH:
                continue
            pdf = pd.concat(held, ignore_index=True)
            h = pdf["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if cut:
                yield from batches(pdf.iloc[:cut])
            held = [pdf.iloc[cut:]]
        if held:
            yield from batches(pd.concat(held, ignore_index=True))

    def batches(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        h = pdf["h"].to_numpy()
        begin = 0
        while begin < len(pdf):
            end = min(begin + _BATCH, len(pdf))
            if end < len(pdf):
                end = int(np.searchsorted(h, h[end])) if int(np.searchsorted(h, h[end])) > begin else int(np.searchsorted(h, h[end], "right"))
            yield build(pdf.iloc[begin:end].reset_index(drop=True))
            begin = end

    return contexts.repartition("h").sortWithinPartitions("h").mapInPandas(run, "doc_id long, th long, begin long, end long")


def _repeated(rows: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """The (stored) rows whose key counts (key, n) twice or more.

    Keys with over a thousandth of the rows, at most 1000 of them, are told by a list, so that no task joins all of one. A key's
    digests belong to one anchor and place, so the columns can be told each by itself.
    """
    hot = counts.filter(F.col("n") > max(1, rows.count() // 1000)).select(*key).collect()
    again = counts.filter("n > 1").select(*key)
    if not hot:
        return rows.join(again, key, "left_semi")
    told = F.lit(True)
    for i, c in enumerate(key):
        told = told & F.col(c).isin(sorted({r[i] for r in hot}))
    return rows.filter(told).unionByName(rows.filter(~told).join(again, key, "left_semi"))


def counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for crowded anchors: every window's hash is counted. Linear in the windows, whatever a group's size.

    A window's block lies at fixed places from the anchor; all its windows hold the block's core, so only blocks whose core
    is counted twice are taken apart.
    """
    reach = length - _GRAM
    fields = "doc_id long, th long, p long, lo long, h long, single boolean, off long, w1 long, w2 long"
    names = [f.split()[0] for f in fields.split(", ")]

    def hashed(blocks: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = [column(batch, c).to_pylist() for c in ("doc_id", "th", "p", "lo", "h", "single", "bytes")]
                found = column(batch, "found").to_pylist() if blocks == 1 else [None] * batch.num_rows
                for doc_id, th, p, lo, h, single, data, some in zip(*cols, found, strict=True):
                    offs, digests = [], []
                    lead, last = p - lo, len(data) - length
                    for off in range(-reach // blocks * blocks, 1, blocks) if some is None else [o + i for o in some for i in range(_BLOCK)]:
                        # of the windows that begin at p + off to p + off + blocks - 1 those that the context has
                        begin, end = max(0, lead + off), min(last, lead + off + blocks - 1)
                        if begin <= end:
                            offs.append(off)
                            # the core of the whole block, or, at the context's border, of its own windows: then it can't be compared
                            whole = end - begin + 1 == blocks
                            digests.append(xxhash.xxh3_128_digest(data[end : begin + length]) if whole else None)
                    keep = [i for i, d in enumerate(digests) if d is not None]
                    border = [i for i, d in enumerate(digests) if d is None]
                    g = np.frombuffer(b"".join(digests[i] for i in keep), np.int64).reshape(-1, 2)
                    pick = np.array(offs, np.int64)[keep + border]
                    n = len(pick)
                    pad = [None] * len(border)
                    yield pa.RecordBatch.from_arrays([*[pa.array([v] * n, pa.int64()) for v in (doc_id, th, p, lo, h)], pa.array([single] * n, pa.bool_()), pa.array(pick), pa.array([*g[:, 0].tolist(), *pad], pa.int64()), pa.array([*g[:, 1].tolist(), *pad], pa.int64())], names)

        return run

    key, ctx = ["h", "off", "w1", "w2"], ["doc_id", "th", "p", "h"]
    twice = lambda rows: _repeated(rows, stored(rows.groupBy(*key).agg(F.count("*").alias("n"))), key)
    blocks = stored(contexts.mapInArrow(hashed(_BLOCK), fields))
    # blocks that a context's border cuts are looked into in any case
    some = twice(blocks.filter("w1 is not null")).unionByName(blocks.filter("w1 is null"))
    open_ = some.groupBy(*ctx).agg(F.collect_set("off").alias("found"))
    on = F.col("c.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("c.th") == F.col("s.th")) & (F.col("c.p") == F.col("s.p")) & (F.col("c.h") == F.col("s.h"))
    windows = stored(contexts.alias("c").join(open_.alias("s"), on).select("c.*", "s.found").mapInArrow(hashed(1), fields))
    return twice(windows).filter("single").select("doc_id", "th", (F.col("p") + F.col("off")).alias("begin"), (F.col("p") + F.col("off") + length).alias("end"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` (doc_id, th, text) with the columns of ``wanted``, one row a document, by a shuffle of the texts that are wanted only."""
    on = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))
    if wanted.count() <= BROADCAST_KEYS:
        docs = docs.alias("d").join(F.broadcast(wanted.select("doc_id", "th")).alias("k"), on("d", "k"), "left_semi")
    rest = [c for c in wanted.columns if c not in ("doc_id", "th")]
    return docs.alias("d").join(wanted.alias("w"), on("d", "w")).select("d.doc_id", "d.th", "d.text", *rest)


def contexts_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The contexts that ``wanted`` (doc_id, th, p, lo, hi, h and others) names, with their bytes."""
    rest = [c for c in wanted.columns if c not in ("doc_id", "th")]
    lists = stored(wanted.groupBy("doc_id", "th").agg(F.collect_set(F.struct(*rest)).alias("want")))
    kept = [c for c in rest if c != "hi"]
    names = ["doc_id", "th", *kept, "bytes"]
    types = [pa.int64(), pa.int64(), *[pa.bool_() if wanted.schema[c].dataType.simpleString() == "boolean" else pa.int64() for c in kept], pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in pieces(batch, "text"):
                out: list[list] = [[] for _ in names]
                for doc_id, th, raw, want in zip(column(part, "doc_id").to_pylist(), column(part, "th").to_pylist(), data, column(part, "want").to_pylist(), strict=True):
                    for w in want:
                        for c, v in zip(out, (doc_id, th, *[w[c] for c in kept], raw[w["lo"] : w["hi"] + length]), strict=True):
                            c.append(v)
                for i in range(0, len(out[0]), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 2000], t) for c, t in zip(out, types, strict=True)], names)

    schema = ", ".join(f"{c} {'boolean' if t == pa.bool_() else 'binary' if t == pa.binary() else 'long'}" for c, t in zip(names, types, strict=True))
    return _texts_of(docs, lists).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = 400, crowd: int = 4096, by_bytes: bool = False) -> DataFrame:
    """(doc_id, th, spans: array of struct(begin, end), unmerged) of the documents with bytes covered by repeated ``length``-byte strings."""
    found = stored(find_anchors(docs, length))
    # tables between two shuffles of their own: Spark can then deal out a join's hot key, as it can't below an aggregation
    again = stored(found.groupBy("h").count().filter("count > 1").select("h"))
    shared = stored(found.join(again, "h", "left_semi"))
    kind = ["h", "g1", "g2"]
    if by_bytes:
        # equal bytes are one row; each task sums its own first. The document and place are of use where the number is 1
        source = contexts_of(docs, shared, length)
        kinds = stored(source.groupBy(*kind, "bytes").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("doc_id", "th", "p", "lo")]))
        if not kinds.groupBy(*kind).count().filter("count > 1").isEmpty():
            raise RuntimeError("two different contexts have one digest")
    else:
        kinds = stored(shared.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "p", "lo", "hi")).alias("one")).select(*kind, "n", "one.*"))
    # equal contexts: repeated from end to end
    whole = _repeated(shared, kinds, kind).select("doc_id", "th", F.col("lo").alias("begin"), (F.col("hi") + length).alias("end"))
    # different contexts of an anchor are built
    several = stored(kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    rows = kinds.join(several, "h").withColumn("single", F.col("n") == 1)
    rows = rows if by_bytes else contexts_of(docs, rows.select("doc_id", "th", "p", "lo", "hi", "h", "single", "kinds"), length)
    built = rows.select("doc_id", "th", "p", "lo", "h", "single", "bytes", "kinds")
    crowded = several.filter(F.col("kinds") > crowd).limit(1).count() > 0
    built = stored(built) if crowded else built
    spans = built_spans(built.filter(F.col("kinds") <= crowd).drop("kinds"), length).unionByName(whole)
    if crowded:
        spans = spans.unionByName(counted_spans(built.filter(F.col("kinds") > crowd).drop("kinds"), length))
    return spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


#: Bytes that stand for a word where passages are counted in words.
_WORD = 3


def word_codes(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, th, text) with _WORD bytes of its hash in place of each word, so that a byte string stands for words of any length and spacing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        for batch in batches:
            for part, data in pieces(batch, "text"):
                out = []
                for x in data:
                    words = x.split()
                    for w in set(words).difference(seen):
                        seen[w] = xxhash.xxh64_digest(w)[:_WORD]
                    out.append(b"".join(map(seen.__getitem__, words)))
                    if len(seen) > 300_000:
                        seen = {}
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "th"), pa.array(out, pa.binary())], ["doc_id", "th", "text"])

    return docs.mapInArrow(run, "doc_id long, th long, text binary")


def passage_words(docs: DataFrame, words: int, crowd: int = 4096) -> DataFrame:
    """(doc_id, th, n_passage_words): words of ``docs`` (doc_id, th, text) in passages of at least so many words that also stand elsewhere; rows without any are left out."""
    spans = repeated_spans(stored(word_codes(docs)), words * _WORD, crowd)
    # codes that are covered whole, in runs that are long enough
    ends = F.transform("spans", lambda x: F.struct(F.ceil(x["begin"] / _WORD).alias("b"), F.floor(x["end"] / _WORD).alias("e")))
    runs = F.aggregate(
        F.array_sort(F.filter(ends, lambda x: x["e"] - x["b"] >= words)),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["b"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
    )
    return spans.select("doc_id", "th", runs["n"].alias("n_passage_words")).filter("n_passage_words > 0")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for b, e in sorted((s["begin"], s["end"]) for s in spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 400, crowd: int = 4096, digests: bool = True, by_bytes: bool = False, words: int = 51) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else, in any document or the same.

    With ``digests``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, n_passage_words; else doc_id, n_bytes, n_removed,
    spans and kept (binary: a cut may fall inside a character). Null texts count as empty; shorter texts keep all. Equal
    rows are copies of each other and lose what they repeat; null ids are told apart by their texts. Other columns are not read.

    n_passage_words: words in passages of at least ``words`` words that also stand elsewhere, however few bytes they have; such
    passages are found by the same construction over three bytes a word, and only reported.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    spans = stored(repeated_spans(own.select("doc_id", "th", "text"), length, crowd, by_bytes))
    names = ["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digests else ["doc_id", "th", "n_bytes", "n_removed", "spans", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in pieces(batch, "text"):
                found = [merged(x or []) for x in column(part, "spans").to_pylist()]
                kept = [b"".join(raw[b:e] for b, e in zip([0, *[e for _, e in runs]], [*[b for b, _ in runs], len(raw)], strict=True)) for raw, runs in zip(data, found, strict=True)]
                head = [column(part, "doc_id"), column(part, "th"), pa.array([len(x) for x in data], pa.int64()), pa.array([len(x) - len(k) for x, k in zip(data, kept, strict=True)], pa.int64())]
                if digests:
                    tail = [pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                else:
                    tail = [pa.array([[{"begin": b, "end": e} for b, e in x] for x in found], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*head, *tail], names)

    schema = "doc_id long, th long, n_bytes long, n_removed long, " + ("n_spans long, kept_sha256 string" if digests else "spans array<struct<begin:long,end:long>>, kept binary")
    # texts without a span are worked off where they lie; only the others move
    touched = _texts_of(own, spans).select("doc_id", "th", "text", "spans").mapInArrow(cut, schema)
    if not digests:
        on = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th"))
        none = own.alias("d").join(spans.select("doc_id", "th").alias("s"), on, "left_anti").withColumn("spans", F.lit(None).cast("array<struct<begin:long,end:long>>"))
        return touched.unionByName(none.select("doc_id", "th", "text", "spans").mapInArrow(cut, schema)).drop("th")
    plain = own.withColumn("spans", F.lit(None).cast("array<struct<begin:long,end:long>>")).mapInArrow(cut, schema)
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))
    new = touched.dropDuplicates(["doc_id", "th"])
    pick = lambda c: F.coalesce(f"b.{c}", f"a.{c}").alias(c)
    said = passage_words(own.select("doc_id", "th", "text"), words, crowd).alias("w")
    told = plain.alias("a").join(new.alias("b"), on, "left").join(said, F.col("a.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("a.th") == F.col("w.th")), "left")
    return told.select("a.doc_id", "a.n_bytes", pick("n_removed"), pick("n_spans"), pick("kept_sha256"), F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words"))
