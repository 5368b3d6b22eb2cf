"""Operator 4: quality rules with line sequence labelling by a linear-chain conditional random field.

Every line is content or boilerplate. The field's weights (a weight of each feature for each label, and of each step between
labels) are fitted by the regularised conditional likelihood of the lines' labels; Viterbi decoding labels the lines of every document,
and the share of words in content lines decides whether it is kept, after base rules on length and repetition.

No line labels exist, so they come from two sources: a line that stands between many different neighbours in the corpus is set into
texts, hence boilerplate, in good documents too; all lines of a document of low quality are boilerplate; the rest is content. So labels
differ within a text. Recurrence, counted over all documents by the lines' hashes, labels the lines of the fit and is no input of the
field: a line's form, its place and its neighbours decide, so lines that stand in one document only are told as well. The fit takes a
bounded sample of labelled documents; every step of L-BFGS sums the gradient over partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces, stored

_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_END = b".!?\"')"
#: Features of a line's form, and with those of its place and neighbours.
FORM, FEATURES = 13, 22
_STRETCH, _PADDED = 64, 20_000


def line_features(line: bytes, repeated: bool) -> list[float]:
    """A line's form, each from 0 to 1."""
    words = line.split()
    n, size = max(1, len(words)), max(1, len(line))
    symbols = (len(line) - len(line.translate(None, _SYMBOLS + b"!=+~^_@"))) / size
    upper = len(line) - len(line.translate(None, _UPPER))
    lower = len(line) - len(line.translate(None, _LOWER))
    distinct = len(set(words)) / n
    odd = sum(w[-1] in b"#*$%&|<>!" for w in words) / n
    return [
        1.0, min(1.0, symbols * 10), float(odd > 0.2), float(odd > 0.5), float(upper > lower), float(upper > 0.25 * (lower + 1)),
        float(n >= 12 and distinct < 0.6), float(n >= 12 and distinct < 0.35), float(len(words) < 4), float(bool(words) and words[-1][-1] in _END),
        float(upper > 0.1 * (lower + 1)), float(repeated), min(1.0, float(np.log1p(n)) / 5),
    ]


def placed_features(rows: list[list[float]], sizes: list[int]) -> list[list[float]]:
    """The lines' form, and each line's place and length beside its neighbours and the document's longest line."""
    length = [min(1.0, float(np.log1p(n)) / 5) for n in sizes]
    longest, last = max(sizes, default=1), len(rows) - 1
    out = []
    for i, row in enumerate(rows):
        above, below = (length[i - 1], rows[i - 1][9]) if i else (0.0, 0.0), (length[i + 1], rows[i + 1][9]) if i < last else (0.0, 0.0)
        beside = [sizes[k] for k in (i - 1, i + 1) if 0 <= k <= last]
        out.append([*row, float(i == 0), float(i == last), sizes[i] / longest, above[0], below[0], above[1], below[1], float(bool(beside) and 2 * sizes[i] < min(beside)), float(row[9] == 0.0 and sizes[i] < 12)])
    return out


def document_lines(data: bytes) -> tuple[list[list[float]], list[int], int, list[int], list[int]]:
    """Of the lines with a word: features, word counts, how many equal an earlier line, hashes, and hashes of their neighbours."""
    seen: set[bytes] = set()
    rows, sizes, dup, hashes = [], [], 0, []
    for line in data.split(b"\n"):
        n = len(line.split())
        if n:
            again = line in seen
            dup += again
            seen.add(line)
            rows.append(line_features(line, again))
            sizes.append(n)
            hashes.append(xxhash.xxh64_intdigest(line))
    places = [xxhash.xxh64_intdigest(b"%d %d" % x) for x in zip([0, *hashes], [*hashes[1:], 0])]
    return placed_features(rows, sizes), sizes, dup, hashes, places


def _pad(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(d) for d in docs])
    x = np.zeros((len(docs), max(1, length.max(initial=1)), FEATURES))
    for i, d in enumerate(docs):
        if len(d):
            x[i, : len(d)] = d
    return x, length


def _batches(order: list[int], docs: list[np.ndarray]) -> Iterator[list[int]]:
    """Documents, sorted by length, in batches of a bounded number of padded lines."""
    pick: list[int] = []
    for i in order:
        if pick and (len(pick) + 1) * len(docs[i]) > _PADDED:
            yield pick
            pick = []
        pick.append(i)
    if pick:
        yield pick


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - m).sum(axis, keepdims=True)) + m).squeeze(axis)


class LineField:
    """Two labels, 1 is content. weights: (features, 2); step: (2, 2) from label to label."""

    def __init__(self, parameters: np.ndarray | None = None) -> None:
        x = np.zeros(2 * FEATURES + 4) if parameters is None else parameters
        self.weights, self.step = x[:-4].reshape(FEATURES, 2), x[-4:].reshape(2, 2)

    def gradient(self, docs: list[np.ndarray], labels: list[np.ndarray], share: list[float]) -> np.ndarray:
        """The lines' log likelihood, documents weighted by ``share``, and behind it its gradient. Long documents go in stretches of lines, so that little is padded."""
        out = np.zeros(1 + 2 * FEATURES + 4)
        cut = sorted(((i, s) for i, d in enumerate(docs) for s in range(0, len(d), _STRETCH)), key=lambda x: min(_STRETCH, len(docs[x[0]]) - x[1]))
        for pick in _batches(list(range(len(cut))), [docs[i][s : s + _STRETCH] for i, s in cut]):
            x, length = _pad([docs[i][s : s + _STRETCH] for i, s in (cut[k] for k in pick)])
            weight = np.array([share[cut[k][0]] for k in pick])
            here = np.arange(x.shape[1])[None, :] < length[:, None]
            gold = np.zeros((*here.shape, 2))
            for r, (i, s) in enumerate(cut[k] for k in pick):
                gold[r, np.arange(length[r]), labels[i][s : s + _STRETCH]] = 1
            e, t, m = x @ self.weights, self.step, x.shape[1]
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for i in range(1, m):
                fwd[:, i] = np.where(here[:, i, None], e[:, i] + _logsum(fwd[:, i - 1, :, None] + t, 1), fwd[:, i - 1])
            for i in range(m - 2, -1, -1):
                bwd[:, i] = np.where(here[:, i + 1, None], _logsum(t + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2), 0)
            z = _logsum(fwd[:, -1], 1)
            p = np.exp(fwd + bwd - z[:, None, None]) * here[:, :, None]
            pair = np.exp(fwd[:, :-1, :, None] + t + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * here[:, 1:, None, None]
            steps = gold[:, :-1, :, None] * gold[:, 1:, None, :]
            out[0] += (((gold * e).sum((1, 2)) + (steps * t).sum((1, 2, 3)) - z) * weight).sum()
            out[1:-4] += np.einsum("nmf,nmk,n->fk", x, gold - p, weight).ravel()
            out[-4:] += np.einsum("nmab,n->ab", steps - pair, weight).ravel()
        return out

    def decode(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi labels of each document's lines; ties go to content."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(docs)
        order = sorted((i for i, d in enumerate(docs) if len(d)), key=lambda i: len(docs[i]))
        for pick in _batches(order, docs):
            x, length = _pad([docs[i] for i in pick])
            e = x @ self.weights
            m, rows = x.shape[1], np.arange(len(pick))
            best = e[:, 0].copy()
            back = np.zeros((m, len(pick), 2), np.int8)
            for i in range(1, m):
                cand = best[:, :, None] + self.step
                back[i] = cand[:, 1] >= cand[:, 0]
                best = np.where((i < length)[:, None], cand.max(1) + e[:, i], best)
            label = (best[:, 1] >= best[:, 0]).astype(np.int8)
            path = np.zeros((len(pick), m), np.int8)
            for i in range(m - 1, -1, -1):
                path[:, i] = label
                label = np.where(i < length, back[i, rows, label], label)
            for r, i in enumerate(pick):
                out[i] = path[r, : length[r]]
        return out


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first one included."""
    windows = list(zip(*[words[i:] for i in range(width)]))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    hit = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    cover = np.zeros(len(words), bool)
    for i in range(width):
        cover[i : i + len(windows)] |= hit
    return int(cover.sum())


def climb(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8, near: float = 1e-4) -> np.ndarray:
    """Maximum of a concave function by L-BFGS; ends when a step gains less than ``near``."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, back = g.copy(), []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            d -= a * y
            back.append(a)
        d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1.0
        for (s, y), a in zip(past, reversed(back), strict=True):
            d += (a - y @ d / (s @ y)) * s
        size = 1.0
        while True:
            there = x + size * d
            f2, g2 = value(there)
            if f2 >= f + 1e-4 * size * (g @ d) or size < 1e-6:
                break
            size /= 4
        s, y, gain = there - x, g - g2, f2 - f
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        if gain > 0:
            x, f, g = there, f2, g2
        if gain < near:
            break
    return x


_PARSED = "rid long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, th long, x binary, sizes array<int>, h array<long>, place array<long>"
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def parsed_lines(docs: DataFrame) -> DataFrame:
    """The base columns of every row (rid, doc_id, text), and of its lines the features in bytes, word counts, hashes and neighbours' hashes; no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in pieces(batch, "text"):
                cols: list[list] = [[] for _ in range(11)]
                for d in data:
                    rows, sizes, dup, hashes, places = document_lines(d)
                    words = d.split()
                    n, repeat = len(words), repeated_words(words)
                    x = np.rint(np.array(rows, float).reshape(-1, FEATURES) * 255).astype(np.uint8).tobytes()
                    signed = [np.array(v, np.uint64).view(np.int64) for v in (hashes, places)]
                    row = (n, len(b"".join(words).decode("utf-8", "replace")), len(d) - len(d.translate(None, _SYMBOLS)), dup, repeat, n < 50 or 100 * repeat > 50 * n, xxhash.xxh64_intdigest(d) - (1 << 63), x, sizes, *signed)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                types = [*[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([column(part, "rid"), column(part, "doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [c.split()[0] for c in _PARSED.split(", ")])

    return docs.mapInArrow(run, _PARSED)


def set_lines(parsed: DataFrame, rids: DataFrame, min_docs: int) -> DataFrame:
    """(rid, at): of some rows the lines (array of places) that stand in at least ``min_docs`` different texts, between as many different neighbours. All rows are counted."""
    each = parsed.select("rid", "th", F.posexplode(F.arrays_zip("h", "place")).alias("at", "l")).select("rid", "th", "at", "l.h", "l.place")
    often = stored(each.groupBy("h").count().filter(F.col("count") >= min_docs).select("h"))
    near = stored(each.join(often, "h"))
    number = lambda c: near.select("h", c).distinct().groupBy("h").agg(F.count("*").alias(f"n_{c}")).filter(F.col(f"n_{c}") >= min_docs)
    found = number("th").join(number("place"), "h").select("h")
    return near.join(F.broadcast(rids), "rid").join(found, "h").groupBy("rid").agg(F.collect_list("at").alias("at"))


def _features(part: pa.RecordBatch) -> list[np.ndarray]:
    """(lines, features) of each row."""
    return [np.frombuffer(raw, np.uint8).reshape(-1, FEATURES) / 255 for raw in column(part, "x").to_pylist()]


def fit_field(lines: DataFrame, labels: DataFrame, id_col: str, label: str, train_docs: int, min_docs: int, rounds: int = 40, penalty: float = 1e-3) -> np.ndarray:
    """The field's parameters, fitted on at most ``train_docs`` labelled documents (those with the smallest hash of the id; of equal ids the row with the fewest words).

    Documents are weighted so that both labels, and within them all documents, count alike.
    """
    pick = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    pick = pick.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(train_docs)
    # the picked ids are a bounded table
    sample = lines.join(F.broadcast(pick), F.col("doc_id") == F.col("id")).groupBy("id", "y").agg(F.min_by(F.struct("x", "rid"), F.struct("n_words", "x", "rid")).alias("l")).select("y", "l.*").filter(F.length("x") > 0)
    sample = stored(sample)
    sample = sample.join(set_lines(lines, sample.select("rid"), min_docs), "rid", "left")
    sample = stored(sample.repartition(sample.sparkSession.sparkContext.defaultParallelism))
    number = dict(sample.groupBy("y").count().collect())
    if len(number) < 2:
        return np.concatenate([[0.0, 1.0], np.zeros(2 * FEATURES + 2)])  # nothing to learn from: content
    spark = sample.sparkSession

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            field, total = LineField(x), np.zeros(1 + len(x))
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    xs = _features(part)
                    y = column(part, "y").to_pylist()
                    gold = [np.full(len(d), k) for d, k in zip(xs, y, strict=True)]
                    for g, at in zip(gold, column(part, "at").to_pylist(), strict=True):
                        g[at or []] = 0
                    total += field.gradient(xs, gold, [0.5 / number[k] / len(d) for k, d in zip(y, xs, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["g"])

        rows = sample.mapInArrow(run, "g array<double>").collect()  # a row of 49 numbers for each partition of the sample
        total = np.sum([r[0] for r in rows], 0)
        return total[0] - penalty / 2 * (x @ x), total[1:] - penalty * x

    return climb(value, np.zeros(2 * FEATURES + 4), rounds)


def labelled_lines(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", train_docs: int = 1500, min_docs: int = 5) -> DataFrame:
    """The base columns of every row, its lines' word counts (sizes) and Viterbi labels (content: array<int>, 1 is content), of lines with a word. No text is shuffled."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("rid", F.monotonically_increasing_id())
    lines = stored(parsed_lines(own))
    shared = docs.sparkSession.sparkContext.broadcast(fit_field(lines, labels, id_col, label, train_docs, min_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = LineField(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                marks = field.decode(_features(part))
                yield pa.RecordBatch.from_arrays([*[column(part, c) for c in [*BASE, "sizes"]], pa.array(marks, pa.list_(pa.int32()))], [*BASE, "sizes", "content"])

    kinds = dict(lines.dtypes)
    return lines.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*BASE, "sizes"]) + ", content array<int>")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", least_content: float = 0.5, train_docs: int = 1500, min_docs: int = 5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_content_words of every row.

    base_failed: under 50 words, or over half of them in repeated three-word windows. kept: not base_failed, and at least
    ``least_content`` of the words in lines labelled content. Null texts have no words and fail. Null ids and equal rows pass
    through; ids with several labels count once, with the largest. Without labels of both kinds every line is content.
    """
    lines = labelled_lines(docs, labels, id_col, text, label, train_docs, min_docs)
    content = F.aggregate(F.zip_with("sizes", "content", lambda n, c: n * c), F.lit(0), lambda a, b: a + b).cast("long")
    kept = ~F.col("base_failed") & (F.col("n_content_words") >= least_content * F.col("n_words"))
    return lines.withColumn("n_content_words", content).select(*BASE, kept.alias("kept"), "n_content_words")
