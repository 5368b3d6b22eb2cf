"""Operator 13: encoding and decoding with SentencePiece vocabularies of the merge type.

A run of symbols is encoded by an agenda: adjacent pairs whose concatenation is a piece wait in a queue ordered by score, then
by place from the left. The best pair is merged, its neighbours form new pairs, and entries that an earlier merge has made
stale are passed over. Symbols that are no piece fall back to their UTF-8 bytes.

A text is first cut where no piece of the vocabulary could ever be merged across: before a run of spaces, around characters that
stand in no longer piece, and between two characters where no piece holds a character of the left one's kind before the
right one. Merges on both sides of such a cut can't meet, so runs are encoded apart and remembered. Decoding gathers the
pieces' bytes by an offset table.

Spaces: the model writes each space as U+2581 and puts one before a text that isn't empty; both are undone by decoding.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces

SPACE = "\u2581"
#: Words and runs of a generation of those remembered.
_CACHE = 400_000
#: Runs of so many symbols have a list as agenda.
_SHORT = 32
#: An entry of the heap is (rank * _PLACES + place) * _SPAN + characters of both symbols, which are at most a piece's.
_PLACES, _SPAN = 1 << 31, 1 << 8
_NEVER = 1 << 62
#: Field numbers of the model file: pieces 1 (text 1, score 2, type 3), trainer 2 (kind of model 3), normaliser 3 (rules 2, first space 3, squeezed spaces 4, U+2581 5). Fixed values of the format.
_PIECE, _TRAINER, _NORMALISER = 1, 2, 3
_TEXT, _SCORE, _TYPE = 1, 2, 3
_KIND, _MERGES = 3, 2
_RULES, _FIRST, _SQUEEZE, _ESCAPE = 2, 3, 4, 5
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else (4 if tag & 7 == 5 else 8, at)
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


def _one_mark_a_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", e.start + 1


codecs.register_error("sparkloom-bytes", _one_mark_a_byte)


class PieceCodec:
    """Encoder and decoder of one model file. Models of another type, with rules of normalisation, with squeezed spaces, or with user-defined or unused pieces are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(x for n, v in top if n == _TRAINER for x in _fields(v))
        rules = dict(x for n, v in top if n == _NORMALISER for x in _fields(v))
        if trainer.get(_KIND, 1) != _MERGES or rules.get(_RULES) or rules.get(_SQUEEZE, 1) or not rules.get(_ESCAPE, 1):
            raise ValueError("only merge-type models without rules of normalisation are read")
        self.first = bool(rules.get(_FIRST, 1))
        spec = [dict(_fields(v)) for n, v in top if n == _PIECE]
        text = [p[_TEXT].decode() for p in spec]
        kind = [p.get(_TYPE, _NORMAL) for p in spec]
        if {_USER, _UNUSED} & set(kind):
            raise ValueError("models with user-defined or unused pieces are not read")
        score = np.frombuffer(b"".join(p.get(_SCORE, bytes(4)) for p in spec), "<f4")
        order = {s: r for r, s in enumerate(sorted(set(score.tolist()), reverse=True))}
        self.id = {t: i for i, t in enumerate(text) if kind[i] == _NORMAL}
        #: Of pieces of two or more characters: where they stand in the order of merges; equal scores share a rank.
        self.rank = {t: order[float(score[i])] * _PLACES for t, i in self.id.items() if len(t) > 1}
        if max(map(len, self.rank), default=0) >= _SPAN:
            raise ValueError("a piece is too long")
        self.unknown = kind.index(_UNKNOWN)
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(text) if kind[i] == _BYTE}
        if len(self.byte) not in (0, 256):
            raise ValueError("byte pieces are incomplete")
        names = [bytes([int(t[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else t.replace(SPACE, " ").encode() for t, k in zip(text, kind, strict=True)]
        names[self.unknown] = b" \xe2\x81\x87 "  # the default mark of unknown pieces
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        #: Ids that have a text, and those whose first space a text's begin takes away.
        self.shown = np.array([k != _CONTROL for k in kind])
        self.spaced = np.array([k == _NORMAL and t.startswith(SPACE) for t, k in zip(text, kind, strict=True)])
        digits = [b"%d," % i for i in range(len(text))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digits_start = np.concatenate([[0], np.cumsum([len(x) for x in digits])])
        self.words, self.plain, self.runs = self._cuts()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cuts(self) -> tuple[re.Pattern[str], Callable[[str], object], re.Pattern[str]]:
        """The words (cut before spaces, and at line ends if no piece holds one) and the runs that a text is cut into, and a test for words of plain letters, that are one run."""
        joined = {c for t in self.rank for c in t}
        inner = {(t[i - 1].isalnum(), t[i]) for t in self.rank for i in range(1, len(t))}
        if any(SPACE in t.lstrip(SPACE) for t in self.rank):
            whole = re.compile(r"(?s).+")
            return whole, whole.fullmatch, whole  # pieces go on after a space: nothing is cut
        word = {c for c in joined if c.isalnum()}
        mark = joined - word - {SPACE}
        #: Marks that no piece has behind a letter or digit begin a run of their own.
        apart = {c for c in mark if (True, c) not in inner}

        def one_of(chars: set[str]) -> str:
            return "[" + "".join(map(re.escape, sorted(chars))) + "]" if chars else "(?!)"

        marks, words, within = one_of(mark), one_of(word), one_of(mark - apart)
        end = "" if "\n" in joined else "\n"
        plain = re.compile(rf"{SPACE}*{one_of({c for c in word if c.isascii()})}+").fullmatch
        return re.compile(rf"{SPACE}*[^{SPACE}{end}]+|{SPACE}+|\n"), plain, re.compile(rf"(?s)(?={one_of(joined | {SPACE})}){SPACE}*+(?:{marks}*+{words}++{within})*+{marks}*+{words}*+|.")

    def encode_run(self, run: str) -> list[int]:
        """The ids of a run, by the agenda."""
        out: list[int] = []
        for symbol in self.merged(run) if len(run) <= _SHORT else self.merged_by_heap(run):
            if (i := self.id.get(symbol)) is not None:
                out.append(i)
            elif self.byte:
                out += map(self.byte.__getitem__, symbol.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def merged(self, run: str) -> list[str]:
        """The symbols that are left of a short run."""
        rank = self.rank.get
        symbols = list(run)
        agenda = [rank(a + b, _NEVER) for a, b in zip(run, run[1:])]  # noqa: B905
        while agenda and (best := min(agenda)) < _NEVER:
            at = agenda.index(best)
            symbols[at] += symbols.pop(at + 1)
            del agenda[at]
            if at < len(agenda):
                agenda[at] = rank(symbols[at] + symbols[at + 1], _NEVER)
            if at:
                agenda[at - 1] = rank(symbols[at - 1] + symbols[at], _NEVER)
        return symbols

    def merged_by_heap(self, run: str) -> Iterator[str]:
        """The symbols that are left of a run of any length."""
        n = len(run)
        rank = self.rank
        after = list(range(1, n + 1))  # where the symbol that begins here ends; 0: it is part of another
        before = list(range(-1, n))  # where the symbol that ends here begins
        agenda = [(r + i) * _SPAN + 2 for i in range(n - 1) if (r := rank.get(run[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            size = entry % _SPAN
            at = entry // _SPAN % _PLACES
            middle = after[at]
            if not middle or middle >= n or after[middle] != at + size:
                continue
            end = at + size
            after[at], after[middle], before[end] = end, 0, at
            if at:
                left = before[at]
                if (r := rank.get(run[left:end])) is not None:
                    heappush(agenda, (r + left) * _SPAN + end - left)
            if end < n and (r := rank.get(run[at : after[end]])) is not None:
                heappush(agenda, (r + at) * _SPAN + after[end] - at)
        at = 0
        while at < n:
            yield run[at : after[at]]
            at = after[at]

    def _run(self, run: str) -> bytes:
        cache = self.cache
        if (ids := cache.get(run)) is None:
            ids = cache[run] = self.older.get(run) or struct.pack(f"<{len(i := self.encode_run(run))}I", *i)
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        words = self.words.findall((SPACE if self.first else "") + text.replace(" ", SPACE))
        if len(self.cache) > _CACHE:
            self.older, self.cache = self.cache, {}
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = self._run(w) if self.plain(w) else self.older.get(w) or b"".join(map(self._run, self.runs.findall(w)))
        ids = np.frombuffer(b"".join(map(cache.__getitem__, words)), "<u4")
        if not self.byte:  # unknown symbols side by side are one, across runs too
            same = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            ids = ids[np.concatenate([[True], ~same])]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Bytes that are no UTF-8 become one U+FFFD each."""
        shown = self.shown[ids]
        first = ids[shown][:1]
        skip = int(self.first and len(first) and bool(self.spaced[first[0]]))
        parts = [ids] if shown.all() else np.split(ids, np.flatnonzero(~shown))  # bytes on both sides of a control piece are no character
        data = [_gather(self.blob, self.start, p) for p in parts]
        at = next((i for i, x in enumerate(data) if x), 0)
        data[at] = data[at][skip:]
        return "".join(x.decode("utf-8", "sparkloom-bytes") for x in data)

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, with commas between them."""
        return _gather(self.digits, self.digits_start, ids)[:-1]


def _gather(blob: np.ndarray, start: np.ndarray, ids: np.ndarray) -> bytes:
    i = ids.astype(np.int64)
    if not len(i):
        return b""
    size = start[i + 1] - start[i]
    ends = np.cumsum(size)
    return blob[np.arange(ends[-1]) + np.repeat(start[i] - (ends - size), size)].tobytes()


_codecs: dict[str, PieceCodec] = {}


def piece_codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def piece_round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", digests: bool = True) -> DataFrame:
    """Encode and decode every text, in Arrow batches. No shuffle.

    With ``digests``: doc_id, n_tokens, ids_sha256, decoded_sha256; else doc_id, ids (array of int) and decoded (string).
    Null and empty texts have no ids and an empty decoded text. Null ids, equal rows and texts of any length pass through (only
    runs between cuts are held as Python objects, a batch's texts by pieces). Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = piece_codec(model_path)
        for batch in batches:
            for part, data in pieces(batch, "text"):
                ids = [c.encode(x.decode("utf-8", "replace")) for x in data]
                if digests:
                    sha = [[hashlib.sha256(y).hexdigest() for y in (c.listed(x), c.decode(x).encode())] for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [column(part, "doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([a for a, _ in sha], pa.string()), pa.array([b for _, b in sha], pa.string())],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def library_differences(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The check against the sentencepiece library, batch by batch: doc_id of every row whose ids or decoded text differ from the library's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        c, library = piece_codec(model_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            for part, data in pieces(batch, "text"):
                texts = [x.decode("utf-8", "replace") for x in data]
                theirs = library.encode(texts, num_threads=1)
                wrong = [c.encode(t).tolist() != i or c.decode(np.array(i, "<u4")) != library.decode(i) for t, i in zip(texts, theirs, strict=True)]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id").filter(pa.array(wrong, pa.bool_()))], ["doc_id"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long")
