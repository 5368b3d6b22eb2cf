"""Operator 1: language-model scoring by Brown's class-based bigrams.

P(text) is the product over its tokens of P(class | class before) * P(word | class). Every training word has a class of its own:

1. Exchange clustering, until nothing moves, of the ``seeds`` most frequent words on the driver: their bigram matrix is bounded.
2. Exchange rounds in Spark over the ``words`` most frequent words and ``forms`` word endings: one row a unit holds the units beside
   it with their counts; a task sums them by class and scores all moves of its units against the grid of class bigrams. The
   moves of a round are made together; where that lowers the likelihood, only every second of them is made, and so on. Rounds end when
   nothing moves, or when a round gains less than ``least_gain`` nats a token.
3. All other training words are assigned by the classes beside their occurrences, where the grid makes these likeliest. Words that
   training never saw have the class of their ending.

Word counts, bigram counts and class totals are taken over the whole training text. The driver and the workers hold the classes of
units, the class grid and the ``HEAD`` most frequent words; all other words are joined.

Emission: a known word has (1 - u) * count / class total; u, the class's share for words never seen, is Good and Turing's
estimate from its words seen once. Transition: interpolated with the class unigram.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fold, pieces, stored

#: Most words whose counts every worker holds; the counts of all others are joined.
HEAD = 262_144
#: Classes whose gain is worked out in a round for each unit: the likeliest to first order.
SHORTLIST = 8
#: Bytes of words that a task holds before it counts them.
_FLUSH = 32 << 20
_KEYS = 4_000_000
#: Most words that are looked up a piece at a time, which numbers them anew; the others are looked up one by one.
_NAMES = 32_768
#: Bytes of text that a worker splits into words at once, which bounds the arrays over them.
_PIECE = 1 << 20


def words_of(docs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, A-Z in lower case, and where each text's end among them. No word is an object of its own."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(docs, pa.binary()).cast(pa.string(), safe=False)))
    words = lists.flatten()
    there = pc.greater(pc.binary_length(words), 0)  # blanks at a text's border leave empty ones
    ends = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()[1:]]
    return words.filter(there).cast(pa.binary()), ends


def apart(words: pa.Array) -> list[bytes]:
    """The words as objects, faster than one by one: no word holds a blank."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py().split()


def places(words: pa.Array, names: pa.Array) -> np.ndarray:
    """Each word's place in ``names``, -1 for words that are not there."""
    return pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy()


def inside(ends: np.ndarray) -> np.ndarray:
    """Of a line of all texts with a border before, between and behind: where words stand."""
    line = np.ones((ends[-1] if len(ends) else 0) + len(ends) + 1, bool)
    line[0] = False
    line[ends + np.arange(1, len(ends) + 1)] = False
    return line


def forms_of(words: pa.Array, forms: int) -> np.ndarray:
    """The endings of words outside the most frequent: their last three bytes, hashed."""
    tails = pc.binary_slice(words, -3).dictionary_encode()
    return np.array([zlib.crc32(x) % forms for x in tails.dictionary.to_pylist()], np.int32)[tails.indices.to_numpy()]


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) over all rows; each task sums what it has read before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for batch in batches:
            for _, docs in pieces(batch, text, _PIECE):
                held.append(words_of(docs)[0])
                if sum(x.nbytes for x in held) > _FLUSH:
                    yield from _counted(held)
        yield from _counted(held)

    return texts.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words held, which are let go."""
    found = pc.value_counts(pa.chunked_array(held, pa.binary()))
    held.clear()
    for i in range(0, len(found), 100_000):
        part = found.slice(i, 100_000)
        yield pa.RecordBatch.from_arrays([part.field("values"), part.field("counts")], ["word", "n"])


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, ``most`` of them or fewer: whole bands of counts, so no tie is cut. Sorted by count and word."""
    band = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(counts.groupBy(band.alias("band")).count().collect(), reverse=True)
    total, least = 0, 1 << 30
    for b, n in sizes:
        total += n
        if total > most:
            break
        least = b
    rows = counts.filter(band >= least).toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


class Units:
    """Word to unit: 0 is the text's border, then the frequent words, then the endings of all others."""

    def __init__(self, names: list[bytes], words: int, forms: int):
        self.known = {w: i + 1 for i, w in enumerate(names[:words])}
        self.names = pa.array(names[:words], pa.binary())
        self.words, self.forms = len(self.known), forms
        self.size = 1 + self.words + forms

    def line(self, docs: list[bytes]) -> tuple[np.ndarray, pa.Array]:
        """Units of all texts in one line, with a border before, between and behind; and the words in it that are no units."""
        words, ends = words_of(docs)
        unit = 1 + places(words, self.names)
        others = words.filter(pa.array(unit == 0))
        unit[unit == 0] = self.words + 1 + forms_of(others, self.forms)
        line = np.zeros(len(words) + len(docs) + 1, np.int32)
        line[inside(ends)] = unit
        return line, others


def word_hash(word: bytes) -> int:
    """Spark's xxhash64 of the word, without its sign."""
    return xxhash.xxh64_intdigest(word, 42)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unit_bigrams(texts: DataFrame, text: str, units) -> DataFrame:
    """(a, b, n): how often unit b follows unit a, borders included. At most size² rows, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: Units = units.value
        held, number = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([*held, np.zeros(0, np.int64)])
            held.clear()  # what the keys are sorted from isn't held beside them
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            for i in range(0, len(first), 100_000):
                part = first[i : i + 100_001]
                n = np.diff(part if len(part) > 100_000 else np.append(part, len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part[: len(n)]]), pa.array(n)], ["ab", "n"])

        for batch in batches:
            for _, docs in pieces(batch, text, _PIECE):
                ids = u.line(docs)[0].astype(np.int64)
                held.append(ids[:-1] * u.size + ids[1:])
                number += len(ids)
                if number > _KEYS:
                    yield from rows()
                    number = 0
        yield from rows()

    size = units.value.size
    # dealt out before they are summed: a task's own are summed already
    found = texts.select(text).mapInArrow(count, "ab long, n long").repartition("ab").groupBy("ab").agg(F.sum("n").alias("n"))
    return found.select((F.col("ab") / size).cast("int").alias("a"), (F.col("ab") % size).cast("int").alias("b"), "n")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(grid: np.ndarray) -> float:
    """What of the bigrams' log likelihood depends on the classes."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(0)).sum() - _xlogx(grid.sum(1)).sum())


def exchange(n: np.ndarray, classes: int) -> np.ndarray:
    """Classes of the units by exchange clustering of their bigram counts ``n``. Unit 0, the border, stays alone in class 0.

    A sweep takes the units by falling count, lifts each out of its class and puts it where the bigram likelihood
    sum N(c,d) log N(c,d) - sum N(c) log N(c) - sum N(d) log N(d) becomes largest, until a sweep moves nothing. Ties stay, then go to
    the lower class. Every move raises the likelihood, so the sweeps end.
    """
    size = len(n)
    order = [int(u) for u in np.argsort(-(n.sum(0) + n.sum(1)), kind="stable") if u]
    of = np.zeros(size, np.int64)
    for i, u in enumerate(order):
        of[u] = 1 + i % (classes - 1)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    right, left = n @ member, n.T @ member  # by unit: counts towards each class, and from it
    grid = member.T @ right
    every, moved = np.arange(classes)[None], 1
    while moved:
        moved = 0
        for u in order:
            a = of[u]
            if not (right[u].any() or left[u].any()):
                continue
            gain = move_gains(grid, right[u : u + 1], left[u : u + 1], n[u : u + 1, u], of[u : u + 1], every)[0]
            b = 1 + int(np.argmax(gain[1:]))
            if gain[b] <= 1e-6:
                continue
            moved += 1
            r, c, own = right[u].copy(), left[u].copy(), n[u, u]
            r[a] -= own
            c[a] -= own
            grid[a] -= r
            grid[:, a] -= c
            grid[a, a] -= own
            grid[b] += r
            grid[:, b] += c
            grid[b, b] += own
            of[u] = b
            right[:, a] -= n[:, u]
            right[:, b] += n[:, u]
            left[:, a] -= n[u]
            left[:, b] += n[u]
    return of


def move_gains(grid: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """(units, k): by how much the likelihood rises if a unit alone moves to each of the classes ``to`` (units, k).

    right, left: a unit's counts before and after each class, itself included; own: how often it follows itself.
    """
    k = np.arange(len(of))
    r, c = right.copy(), left.copy()
    r[k, of] -= own
    c[k, of] -= own
    home = to == of[:, None]

    def rise(grid: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of the classes without the unit: what they gain in cells and lose in sums, and their diagonal."""
        g = grid[to]
        g[k, :, of] -= c[k[:, None], to]
        g -= home[:, :, None] * r[:, None, :]
        g[k, :, of] -= home * own[:, None]
        np.maximum(g, 0, out=g)
        diag = np.take_along_axis(g, to[:, :, None], 2)[:, :, 0]
        cells = _xlogx(g + r[:, None, :]) - _xlogx(g)
        # what stands before the unit is in its class's sum wherever the unit goes
        total, n = g.sum(2) + c[k[:, None], to], r.sum(1)[:, None] + own[:, None]
        return cells.sum(2) - np.take_along_axis(cells, to[:, :, None], 2)[:, :, 0], _xlogx(total + n) - _xlogx(total), diag

    (rows, out, diag), (cols, into, _) = rise(grid, r, c), rise(grid.T, c, r)
    at = np.take_along_axis(r + c, to, 1) + own[:, None]
    gain = rows + cols + _xlogx(diag + at) - _xlogx(diag) - out - into
    stay = np.where(home, gain, 0).sum(1) / np.maximum(home.sum(1), 1)
    return gain - stay[:, None]


def _by_class(batch: pa.RecordBatch, side: str, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, classes): the counts of a row's neighbours on one side by their class, -1 being none; and how often a row is its own neighbour."""
    lists = column(batch, side)
    size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    v, n = flat.field("v").to_numpy(), flat.field("n").to_numpy()
    row, c = np.repeat(np.arange(batch.num_rows), size), of[v]
    total = np.bincount((row * classes + c)[c >= 0], n[c >= 0], batch.num_rows * classes).reshape(-1, classes)
    itself = v == np.repeat(column(batch, "u").to_numpy(), size)
    return total, np.bincount(row[itself], n[itself], batch.num_rows)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


class Rounds:
    """Exchange rounds over the units, one row each: (u, right, left), arrays of (v, n). A row holds at most twice the units, whatever the corpus."""

    def __init__(self, bigrams: DataFrame, classes: int):
        self.spark, self.classes = bigrams.sparkSession, classes
        side = lambda u, v, after: F.struct(F.col(u).alias("u"), F.lit(after).alias("after"), F.struct(F.col(v).alias("v"), "n").alias("x"))
        beside = bigrams.select(F.explode(F.array(side("a", "b", True), side("b", "a", False))).alias("e")).select("e.*")
        self.units = stored(beside.groupBy("u").agg(F.collect_list(F.when(F.col("after"), F.col("x"))).alias("right"), F.collect_list(F.when(~F.col("after"), F.col("x"))).alias("left")))

    def _best(self, of: np.ndarray, choose) -> tuple[np.ndarray, np.ndarray]:
        """(unit, class) of the rows that ``choose`` picks, by falling gain; at most one row a unit reaches the driver."""
        shared, classes = self.spark.sparkContext.broadcast(of), self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = shared.value
            for part in _slices(batches):
                u = column(part, "u").to_numpy()
                (right, own), (left, _) = _by_class(part, "right", of, classes), _by_class(part, "left", of, classes)
                pick, best, gain = choose(u, of[u], right, left, own)
                yield pa.RecordBatch.from_arrays([pa.array(u[pick]), pa.array(best[pick]), pa.array(gain[pick])], ["u", "best", "gain"])

        found = self.units.mapInArrow(run, "u int, best long, gain double").toArrow()
        shared.unpersist()
        u, best = found["u"].to_numpy(), found["best"].to_numpy()
        order = np.lexsort((u, -found["gain"].to_numpy()))
        return u[order], best[order]

    def placed(self, of: np.ndarray, grid: np.ndarray) -> np.ndarray:
        """``of`` with the units without a class (-1) put where their neighbours that have one make them likeliest."""
        after, before = assignment(grid)
        u, best = self._best(of, lambda u, mine, right, left, own: (mine < 0, 1 + (right @ after.T + left @ before)[:, 1:].argmax(1), np.zeros(len(u))))
        out = np.where(of < 0, 1 + np.arange(len(of)) % (self.classes - 1), of)
        out[u] = best
        return out

    def moves(self, of: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after, before = assignment(grid)
        most = min(SHORTLIST, self.classes - 1)

        def choose(u, mine, right, left, own):
            fit = (right @ after.T + left @ before)[:, 1:]
            to = np.hstack([mine[:, None], 1 + np.argpartition(-fit, most - 1, axis=1)[:, :most]])
            gain = move_gains(grid, right, left, own, mine, to)
            best, k = gain.argmax(1), np.arange(len(u))
            return (gain[k, best] > 1e-6) & (u > 0), to[k, best], gain[k, best]

        return self._best(of, choose)

    def grid(self, of: np.ndarray) -> np.ndarray:
        """Class bigrams of the units that have a class."""
        shared, classes = self.spark.sparkContext.broadcast(of), self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, total = shared.value, np.zeros((classes, classes))
            for part in _slices(batches):
                mine = of[column(part, "u").to_numpy()]
                np.add.at(total, mine[mine >= 0], _by_class(part, "right", of, classes)[0][mine >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes)), pa.array(total.ravel())], ["cell", "n"])

        found = self.units.select("u", "right").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        shared.unpersist()
        out = np.zeros(classes * classes)
        out[found["cell"].to_numpy()] = found["n"].to_numpy()
        return out.reshape(classes, classes)

    def settle(self, of: np.ndarray, least_gain: float) -> tuple[np.ndarray, int]:
        """Classes when nothing moves or a round gains under ``least_gain`` nats a token, and how many units would still move alone."""
        grid = self.grid(of)
        now, tokens = likelihood(grid), max(1.0, grid.sum())
        while True:
            u, best = self.moves(of, grid)
            if not len(u):
                return of, 0
            go = len(u)
            while True:  # all moves, or the half, quarter and so on that gain most alone; a single one does raise the likelihood
                trial = of.copy()
                trial[u[:go]] = best[:go]
                there = self.grid(trial)
                gain = likelihood(there) - now
                if gain > 0 or go == 1:
                    break
                go = -(-go // 2)
            if gain <= 0:
                return of, len(u)
            of, grid, now = trial, there, now + gain
            if gain < least_gain * tokens:
                return of, len(self.moves(of, grid)[0])


def assignment(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, classes) twice: what a neighbour of class d after, or of class c before, adds to the likelihood of a rare word's class.

    right[c, d] = log P(d after c), left[c, d] = log P(d after c) - log P(d): the change of the bigram likelihood to first order.
    """
    g = grid + 0.1
    right = np.log(g) - np.log(g.sum(1, keepdims=True))
    return right, np.log(g) - np.log(g.sum(0, keepdims=True))


def rest_of(texts: DataFrame, text: str, units, of: np.ndarray, grid: np.ndarray) -> DataFrame:
    """(word, n, cls) of the training words that are no units, word being its hash, by the classes beside them; rows without a word are the class bigrams they are in, cls being the cell.

    Beside two such words the other's ending stands for it, and either counts the pair half. Words are dealt out by hash; none is
    more frequent than the units.
    """
    classes = len(grid)
    spark = texts.sparkSession
    shared, fit = spark.sparkContext.broadcast(of), spark.sparkContext.broadcast(assignment(grid))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: Units = units.value
        for batch in batches:
            for _, docs in pieces(batch, text, _PIECE):
                ids, others = u.line(docs)
                rare = np.flatnonzero(ids > u.words)
                side = (shared.value[ids] + classes * (ids > u.words)).astype(np.int32)  # others by their ending, marked
                yield pa.RecordBatch.from_arrays([others, pa.array(side[rare - 1] * (2 * classes) + side[rare + 1])], ["word", "pq"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before = fit.value
        # by the class beside: what it adds for each class
        after, before = np.vstack([after.T, after.T]), np.vstack([before, before])
        weight = np.repeat([1.0, 0.5], classes)
        left, right = np.zeros((2 * classes, classes)), np.zeros((2 * classes, classes))  # by class beside and own class
        last: tuple[int, np.ndarray, np.ndarray] | None = None  # the last word may go on: its neighbours' counts

        def decided(word: int, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            cls = 1 + int((p @ before + q @ after)[1:].argmax())
            left[:, cls] += p
            right[:, cls] += q
            return made([word], [p.sum()], [cls])

        def made(words, n, cls) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(np.array(n, float)), pa.array(np.array(cls, np.int32))], ["word", "n", "cls"])

        count = lambda x: np.bincount(x, minlength=2 * classes).astype(float)
        for batch in batches:
            for begin in range(0, batch.num_rows, 50_000):
                part = batch.slice(begin, 50_000)
                word = column(part, "word").to_numpy()
                p, q = np.divmod(column(part, "pq").to_numpy(), 2 * classes)
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                if last and last[0] == word[0]:
                    end = first[1] if len(first) > 1 else len(word)
                    last = (last[0], last[1] + count(p[:end]), last[2] + count(q[:end]))
                    first = first[1:]
                    if not len(first):
                        continue
                if last:
                    yield decided(*last)
                last = (int(word[-1]), count(p[first[-1] :]), count(q[first[-1] :]))
                if len(first) > 1:
                    s = slice(first[0], first[-1])
                    p, q, begins = p[s], q[s], first[:-1] - first[0]
                    cls = 1 + np.add.reduceat(before[p] + after[q], begins)[:, 1:].argmax(1)
                    size = np.diff(first)
                    each = np.repeat(cls, size)
                    left += np.bincount(p.astype(np.int64) * classes + each, minlength=left.size).reshape(left.shape)
                    right += np.bincount(q.astype(np.int64) * classes + each, minlength=right.size).reshape(right.shape)
                    yield made(word[first[:-1]], size, cls)
        if last:
            yield decided(*last)
        total = (left * weight[:, None]).reshape(2, classes, classes).sum(0) + (right * weight[:, None]).reshape(2, classes, classes).sum(0).T
        cells = np.flatnonzero(total.ravel())
        yield made([None] * len(cells), total.ravel()[cells], cells)

    met = texts.select(text).mapInArrow(around, "word binary, pq int").select(F.xxhash64("word").alias("word"), "pq")
    dealt = met.repartition("word").sortWithinPartitions("word")
    return stored(dealt.mapInArrow(assign, "word long, n double, cls int"))


class Model:
    """What a worker needs to score: the endings' classes, log10 transitions, and the frequent words' classes and log10 emissions.

    grid: class bigrams; total, once: by class, the count of its words and how many of them were seen once; head: (word, count, class).
    """

    def __init__(self, forms: np.ndarray, grid: np.ndarray, total: np.ndarray, once: np.ndarray, head: list[tuple[bytes, int, int]], tokens: int, types: int, border: int, prior: float):
        classes = len(grid)
        unigram = (total + 1) / (total.sum() + classes)
        self.move = np.log10((grid + prior * unigram) / (grid.sum(1, keepdims=True) + prior))
        unseen = (once + 1) / (total + 2)
        unseen[0] = 0.0  # the end has no unseen words
        with np.errstate(divide="ignore"):
            self.unseen = np.log10(unseen)
            self.share = np.log10(1 - unseen) - np.log10(np.maximum(total, 1))
        self.forms = forms
        self.floor, self.scale = 0.1, tokens + 0.1 * (types + 1)
        self.border_base = math.log10((border + 0.1) / self.scale)
        #: By word: row in the arrays below.
        self.row = {w: i for i, (w, _, _) in enumerate(head)}
        self.names = pa.array([w for w, _, _ in head[:_NAMES]], pa.binary())
        counts = np.array([n for _, n, _ in head], float)
        self.head_class = np.array([c for _, _, c in head], np.int64)
        self.head_base = np.log10((counts + 0.1) / self.scale)
        self.head_log = self.share[self.head_class] + np.log10(np.maximum(counts, 1))

    def rows(self, words: pa.Array) -> np.ndarray:
        """Each word's row, -1 for words that are not held."""
        rows = places(words, self.names).copy()
        left = np.flatnonzero(rows < 0)
        rows[left] = np.fromiter(map(self.row.get, apart(words.take(pa.array(left))), repeat(-1)), np.int32, len(left))
        return rows


_SCORED = ["rid", "pos", "word", "p", "q", "form", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]


def _score(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for part, docs in pieces(batch, "text", _PIECE):
                n = len(docs)
                rids = column(part, "rid").to_numpy()
                words, ends = words_of(docs)
                lengths = np.diff(ends, prepend=0)
                rows = m.rows(words)
                owner = np.repeat(np.arange(n), lengths)
                known = rows >= 0
                # the text's classes between two borders, all texts in one line; -1 for words that are joined
                at = np.flatnonzero(inside(ends))
                line = np.zeros(len(words) + n + 1, np.int64)
                line[at] = np.where(known, m.head_class[rows] if len(m.head_class) else 0, -1)
                both = (line[:-1] >= 0) & (line[1:] >= 0)
                step = np.where(both, m.move[line[:-1], line[1:]], 0.0)
                score = np.add.reduceat(step, np.cumsum(lengths + 1) - lengths - 1) if n else np.zeros(0)
                score += np.bincount(owner[known], m.head_log[rows[known]], n)
                base = np.bincount(owner[known], m.head_base[rows[known]], n) + m.border_base
                yield pa.RecordBatch.from_arrays(
                    # the key of a text's own row is no word and spreads the rows in the join
                    [pa.array(rids), pa.array([-1] * n, pa.int64()), pa.array([b" %d" % r for r in rids.tolist()], pa.binary()), *[pa.nulls(n, pa.int32())] * 3, column(part, "doc_id"), column(part, "held_out"), pa.array(lengths + 1), pa.array(np.bincount(owner[known], minlength=n) + 1), pa.array(base), pa.array(score)],
                    _SCORED,
                )
                rare = np.flatnonzero(~known)
                for i in range(0, len(rare), 50_000):
                    some = rare[i : i + 50_000]
                    place, others, k = at[some], words.take(pa.array(some)), len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rids[owner[some]]), pa.array(place), others, pa.array(line[place - 1].astype(np.int32)), pa.array(line[place + 1].astype(np.int32)), pa.array(m.forms[forms_of(others, len(m.forms))].astype(np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), *[pa.nulls(k, pa.int64())] * 2, *[pa.nulls(k, pa.float64())] * 2],
                        _SCORED,
                    )

    return run


def _numbers(x: np.ndarray) -> Column:
    """The numbers as a constant array."""
    return F.split(F.lit(",".join(repr(float(v)) for v in np.maximum(x, -99).ravel())), ",").cast("array<double>")


def class_bigram_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 10, words: int = 16_384, forms: int = 256, seeds: int = 256, classes: int = 64, least_gain: float = 1e-3, prior: float = 20.0) -> DataFrame:
    """Score every row of ``docs`` by a model learnt from the rows whose ``fold(id, folds)`` is not 0.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (10 ** (-score / n_tokens)).
    Null texts count as empty (the end alone); null ids as the empty text in the fold; equal rows each give a row. With no
    training rows every word is unknown and all scores stay finite. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("held_out", fold("doc_id", folds) == 0)
    train = docs.filter(~F.col("held_out"))
    counts = stored(word_counts(train, "text"))
    n_words, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = frequent(counts, HEAD)
    units = Units([w for w, _ in head], words, forms)
    shared = spark.sparkContext.broadcast(units)
    bigrams = stored(unit_bigrams(train, "text", shared))
    # seeds by exchange on the driver, then all units in rounds
    first = min(seeds, units.words) + 1
    found = bigrams.filter((F.col("a") < first) & (F.col("b") < first)).toArrow()
    matrix = np.zeros((first, first))
    matrix[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    of = np.full(units.size, -1)
    of[:first] = exchange(matrix, classes)
    member = np.eye(classes)[of[:first]]
    rounds = Rounds(bigrams, classes)
    of, _ = rounds.settle(rounds.placed(of, member.T @ matrix @ member), least_gain)
    rest = rest_of(train, "text", shared, of, rounds.grid(of))
    # the model's class bigrams: of units that are words, and of all other words as they are assigned
    grid = rounds.grid(np.where(np.arange(units.size) <= units.words, of, -1))
    for cell, n in rest.filter("word is null").groupBy("cls").agg(F.sum("n")).collect():
        grid[cell // classes, cell % classes] += n
    # every text ends in a border
    border = train.count()
    total, once = np.zeros(classes), np.zeros(classes)
    total[0] = border
    rest = rest.filter("word is not null")
    for cls, n, k in rest.groupBy("cls").agg(F.sum("n"), F.count_if(F.col("n") == 1)).collect():
        total[cls], once[cls] = n, k
    for w, n in head[: units.words]:
        total[of[units.known[w]]] += n
        once[of[units.known[w]]] += n == 1
    least = head[-1][1] if head else 0
    told = rest.filter(F.col("n") >= least).toArrow() if len(head) > units.words else None  # the head's words
    joined = dict(zip(told["word"].to_pylist(), told["cls"].to_pylist(), strict=True)) if told else {}
    named = [(w, n, int(of[units.known[w]]) if w in units.known else joined[signed(word_hash(w))]) for w, n in head]
    # words that workers don't hold, with counts and classes
    tail = counts.filter(F.col("n") < least).select("word", "n", F.xxhash64("word").alias("h")).join(rest.select(F.col("word").alias("h"), "cls"), "h").drop("h")
    tokens = n_words + border
    model = Model(of[units.words + 1 :], grid, total, once, named, tokens, types + (border > 0), border, prior)
    scored = docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_score(spark.sparkContext.broadcast(model)), "rid long, pos long, word binary, p int, q int, form int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    share, unseen, move = _numbers(model.share), _numbers(model.unseen), _numbers(model.move)
    own = F.col("pos") < 0
    with_class = scored.join(tail, "word", "left").select("rid", "pos", "p", "q", "n", F.coalesce("cls", "form").alias("c"), "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
    # a text's joined words in order: where one stands before another, its class is the other's class before
    before = F.when(F.col("p") >= 0, F.col("p")).otherwise(F.lag("c").over(Window.partitionBy("rid").orderBy("pos")))
    step = lambda a, b: F.element_at(move, (a * classes + b + 1).cast("int"))
    emitted = F.when(F.col("n").isNotNull(), F.log10("n") + F.element_at(share, F.col("c") + 1)).otherwise(F.element_at(unseen, F.col("c") + 1))
    each = with_class.withColumn("before", before).select(
        "rid", "doc_id", "held_out", "n_tokens",
        F.when(own, F.col("n_known")).when(F.col("n").isNotNull(), 1).otherwise(0).alias("n_known"),
        F.when(own, F.col("base")).otherwise(F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(model.scale))).alias("base"),
        F.when(own, F.col("score")).otherwise(emitted + step(F.col("before"), F.col("c")) + F.when(F.col("q") >= 0, step(F.col("c"), F.col("q"))).otherwise(0.0)).alias("score"),
    )
    out = each.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").cast("long").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
