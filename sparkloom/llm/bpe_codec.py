"""Operator 10: BPE encoding by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick pass over a word gives the longest token that begins at each of its symbols. The encoder takes the longest
one; if it does not stand beside the token before (the merge order would have cut elsewhere), it tries that token's longest
prefix that is a token, and at last steps back. A position proved dead is never tried again, so the work is linear in the
word. Whether two tokens may stand side by side is worked out from the merges that made them, and kept in a table.

The vocabulary is one with word ends: lower case, white space dropped, each word's last symbol carries the end mark.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces
from .token_counts import byte_symbols

#: Split of the word-end pre-tokenizer. A fixed value of the vocabulary's format.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end mark inside the automaton: one character that no byte symbol uses.
_END = "￿"
_CACHE = 300_000


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        self.symbol = byte_symbols()
        inner = {t[: -len(mark)] + _END if t.endswith(mark) else t: i for t, i in vocab.items()}
        size = max(vocab.values()) + 1
        #: Rank of the merge that made a token (single symbols: -1 and themselves as halves).
        self.rank, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        self.pair: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (m.split(" ") if isinstance(m, str) else m))
            c = vocab["".join(m.split(" ") if isinstance(m, str) else m)]
            self.pair[a, b] = c
            if self.rank[c] < 0:
                self.rank[c], self.left[c], self.right[c] = r, a, b
        self.fits: dict[tuple[int, int], bool] = {}
        # only tokens that their own merges lead back to can appear in an encoding
        self.length = [0] * size
        usable = {}
        for t, i in sorted(inner.items(), key=lambda x: self.rank[x[1]]):
            self.length[i] = len(t)
            if self.rank[i] < 0 or self.compatible(self.left[i], self.right[i], self.rank[i]):
                usable[t] = i
        self.longest = ahocorasick.Automaton()
        for t, i in usable.items():
            self.longest.add_word(t, i)
        self.longest.make_automaton()
        #: The longest shorter token that a token begins with.
        self.prefix: list[int | None] = [None] * size
        for t, i in usable.items():
            self.prefix[i] = next((usable[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), None)
        names = [b""] * max(size, 1 + max([t["id"] for t in spec["added_tokens"]], default=0))
        for t, i in vocab.items():
            names[i] = t.encode() + b" "
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            names[i] = t.encode() + b" "
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Decoding: token i is blob[start[i]:start[i + 1]].
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        self.word = regex.compile(WORD)
        self.cache: dict[str, bytes] = {}

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """May tokens a and b stand side by side? Undo their merges, the later one first, and look for an earlier merge across the border.

        below: only merges of a lower rank count (for the halves of a token, whose own merge comes last).
        """
        if below is None and (known := self.fits.get((a, b))) is not None:
            return known
        x, y = a, b
        limit = 1 << 40 if below is None else below
        rank, pair = self.rank, self.pair
        ok = True
        while True:
            c = pair.get((x, y))
            if c is not None and rank[c] < limit:
                ok = False
                break
            # a merge across the border after which a half would be made: the left half's own merge wins a tie of order
            if rank[x] < 0 and rank[y] < 0:
                break
            if rank[x] >= rank[y]:
                limit = min(limit, rank[x])
                x = self.right[x]
            else:
                limit = min(limit, rank[y] + 1)
                y = self.left[y]
        if below is None:
            if len(self.fits) > 1_000_000:
                self.fits = {}
            self.fits[a, b] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        text = "".join(map(self.symbol.__getitem__, data)) + _END
        n = len(text)
        best: list[int | None] = [None] * n
        for end, i in self.longest.iter(text):  # ends rise, so the last one written is the longest
            best[end + 1 - self.length[i]] = i
        open_at = [True] * (n + 1)
        open_at[n - 1] = False  # the end mark belongs to the last symbol
        out: list[int] = []
        at, token = 0, best[0]
        while token is not None:
            last = out[-1] if out else None
            while token is not None:
                end = at + self.length[token]
                if open_at[end] and (last is None or self.compatible(last, token)):
                    break
                token = self.prefix[token]
            if token is not None:
                out.append(token)
                at = end
                token = best[at] if at < n else None
            else:
                open_at[at] = False
                out.pop()
                at -= self.length[last]
                token = last
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if self.split is None or not self.split.search(text):
            return self._encode(text)
        return b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else self._encode(p) for p in self.split.split(text))

    def _encode(self, text: str) -> bytes:
        # lower case character by character: the final sigma has no form of its own here
        words = self.word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        cache = self.cache
        if len(cache) > _CACHE:
            cache = self.cache = {}
        for w in set(words).difference(cache):
            cache[w] = np.array(self.encode_word(w), "<u4").tobytes()
        return b"".join(map(cache.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts with blanks between them, as this vocabulary (which names no decoder) is decoded."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return b""
        size = self.start[i + 1] - self.start[i]
        ends = np.cumsum(size)
        return self.blob[np.arange(ends[-1]) + np.repeat(self.start[i] - (ends - size), size)].tobytes()[:-1]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe_round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text: str = "text", digests: bool = True) -> DataFrame:
    """Encode and decode every text. No shuffle.

    With ``digests``: doc_id, n_tokens, ids_sha256, decoded_sha256; else doc_id, ids (array of int) and decoded (string).
    Null texts count as empty: no ids, an empty decoded text. Null ids and equal rows pass through. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for batch in batches:
            for part, data in pieces(batch, "text"):
                ids = [c.encode(x.decode("utf-8", "replace")) for x in data]
                if digests:
                    sha = [hashlib.sha256(x).hexdigest() for x in ids]
                    yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([c.decode(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
