"""Operator 2: token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Pre-tokens of many texts lie in one array of symbols. In each round every sequence finds its pair of lowest rank and merges
all its occurrences at once; a sequence with no pair left is done and leaves the arrays. Merged symbols only form pairs of
higher rank than their own, so a round does what the one-by-one merge would do next. The symbols left over are counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces

#: Split of the byte-level pre-tokenizer. A fixed value of the vocabulary's format.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int64(1 << 40)
_CACHE = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Pairs of symbol ids with rank and result, found by binary search; built from the vocabulary file in each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.cache: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def lengths(self, words: list[str]) -> np.ndarray:
        """Symbols of each word after all merges."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(x) for x in data], np.int64)
        left = size.copy()
        sym = self.first[np.frombuffer(b"".join(data), np.uint8)]
        which = np.repeat(np.arange(len(words)), size)
        last = np.ones(len(sym), bool)
        last[:-1] = which[1:] != which[:-1]
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            n = np.diff(np.append(starts, len(sym)))
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest < _NONE
            if not going.all():  # done: out of the arrays
                left[which[starts[~going]]] = n[~going]
                keep = np.repeat(going, n)
                sym, which, rank, lowest, n = sym[keep], which[keep], rank[keep], lowest[going], n[going]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, n))
            # in a run of overlapping pairs (x x x) every other one merges, from the left
            new_run = np.ones(len(hit), bool)
            new_run[1:] = np.diff(hit) != 1
            begin = np.maximum.accumulate(np.where(new_run, hit, 0))
            hit = hit[(hit - begin) % 2 == 0]
            sym[hit] = self.result[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = (np.cumsum(keep) - 1)[hit]
            sym, which, rank = sym[keep], which[keep], rank[keep]
            changed = np.unique(np.concatenate([place, place[place > 0] - 1]))
            inner = changed[changed + 1 < len(sym)]
            inner = inner[which[inner] == which[inner + 1]]
            rank[changed] = _NONE
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        return left

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special tokens stand in it."""
        if self.special is None or not (found := self.special.findall(text)):
            return self.pattern.findall(text), 0
        return [w for part in self.special.split(text) for w in self.pattern.findall(part)], len(found)

    def count(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        if len(self.cache) > _CACHE:
            self.cache = {}
        new = list({w for words, _ in split for w in words}.difference(self.cache))
        self.cache.update(zip(new, self.lengths(new).tolist(), strict=True))
        return [sum(map(self.cache.__getitem__, words)) + n for words, n in split]


_tables: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    if path not in _tables:
        _tables[path] = MergeTable(path)
    return _tables[path]


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row; no shuffle.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids and equal rows pass through. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = merge_table(vocab_path)
        for batch in batches:
            for part, data in pieces(batch, "text"):
                n = t.count([x.decode("utf-8", "replace") for x in data])
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
