"""Operator 5: language identification by rank-order n-gram profiles (Cavnar and Trenkle).

N-grams are of one to three bytes of the UTF-8 text, lower-cased in A-Z, with everything but letters turned into blanks. A
language's profile is its ``size`` most frequent n-grams over all rows it is learnt from; a document goes to the language
whose ranks its own most frequent n-grams are out of place by least.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fold, pieces

UNKNOWN = "und"
#: N-grams that a worker holds.
_FLUSH = 500_000
#: Bytes as letters: A-Z lower-cased, a-z and all of other scripts kept, the rest blank.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_BLANK = 0x20


def grams(data: bytes) -> np.ndarray:
    """All n-grams as integers: n in the top bits, the bytes below. Those that hold two blanks or are one are left out."""
    b = np.frombuffer(b" " + data.translate(_LETTERS) + b" ", np.uint8).astype(np.int32)
    gap = b == _BLANK
    two = (b[:-1] << 8) | b[1:]
    pair_ok = ~(gap[:-1] & gap[1:])
    return np.concatenate([b[~gap], two[pair_ok] | 1 << 24, ((two[:-1] << 8) | b[2:])[~gap[1:-1]] | 2 << 24])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def has_letter(data: bytes) -> bool:
    """Any letter of any script."""
    if data.translate(None, bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))) != data:
        return True
    return not data.isascii() and any(c.isalpha() for c in data.decode("utf-8", "replace"))


def language_profiles(docs: DataFrame, text: str, lang: str, size: int = 300) -> DataFrame:
    """(lang, key, place): each language's most frequent n-grams over all rows, ties by key. ``size`` rows a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: defaultdict[str, Counter] = defaultdict(Counter)

        def held() -> Iterator[pa.RecordBatch]:
            for name, c in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(c), pa.string()), pa.array(list(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["lang", "key", "n"])
            total.clear()

        for batch in batches:
            for part, data in pieces(batch, text):
                by: defaultdict[str, list[bytes]] = defaultdict(list)
                for name, x in zip(column(part, lang).to_pylist(), data, strict=True):
                    by[name].append(x)
                for name, xs in by.items():
                    keys, n = counted(grams(b" ".join(xs)))
                    total[name].update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
                if sum(map(len, total.values())) > _FLUSH:
                    yield from held()
        yield from held()

    counts = docs.filter(F.col(lang).isNotNull()).select(text, F.col(lang).alias(lang)).mapInArrow(count, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # the first of each share of a language's n-grams, then the first of these
    place = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "key"))
    first = counts.withColumn("place", place(F.pmod(F.hash("key"), F.lit(64)))).filter(F.col("place") <= size)
    return first.withColumn("place", place() - 1).filter(F.col("place") < size).select("lang", "key", "place")


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.keys = np.array(sorted({r[1] for r in rows}), np.int32)
        #: Place of each key in each language's profile, -1 where it isn't in it.
        self.place = np.full((len(self.langs), len(self.keys)), -1, np.int32)
        for name, key, place in rows:
            self.place[self.langs.index(name), np.searchsorted(self.keys, key)] = place

    def predict(self, data: bytes) -> tuple[str, float]:
        """Language and score: one less the out-of-place distance as a share of the largest possible."""
        if not self.langs or not has_letter(data):
            return UNKNOWN, 0.0
        keys, n = counted(grams(data))
        top = np.sort((np.int64(1 << 36) - n.astype(np.int64) << 27) | keys)[: self.size] & ((1 << 27) - 1)
        at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        place = np.where(self.keys[at] == top, self.place[:, at], -1)
        out = np.where(place < 0, self.size, np.abs(place - np.arange(len(top)))).sum(1)
        best = int(np.argmin(out))
        return self.langs[best], float(1 - out[best] / (len(top) * self.size))


def identify_languages(docs: DataFrame, profiles: list[tuple[str, int, int]], keep: list[str], text: str = "text", size: int = 300, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the language and its score added under ``names``; no shuffle. Profiles are a few hundred rows a language."""
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Profiles = shared.value
        for batch in batches:
            for part, data in pieces(batch, text):
                found = [p.predict(x) for x in data]
                yield pa.RecordBatch.from_arrays([*[column(part, c) for c in keep], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*keep, *names])

    read = docs.select(*dict.fromkeys([*keep, text]))
    schema = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep)
    return read.mapInArrow(run, f"{schema}, {names[0]} string, {names[1]} double")


def languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, held: int = 1, size: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learnt from text and non-null lang of rows whose ``fold(id, folds)`` is not ``held``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if there is nothing to learn from. Ties go
    to the language whose name comes first. Null ids have the fold of the empty text; equal rows each give a row.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    learn = own.filter(fold("doc_id", folds) != held)
    rows = [tuple(r) for r in language_profiles(learn, "text", "lang", size).collect()]
    found = identify_languages(own.withColumn("held_out", fold("doc_id", folds) == held).drop("lang"), rows, ["doc_id", "held_out"], "text", size)
    return found.select("doc_id", "held_out", "lang_pred", "score")
