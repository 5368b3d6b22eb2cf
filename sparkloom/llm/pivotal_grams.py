"""Operator 12: grouping of spelling variants by pivotal grams.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Bigrams are ordered by the number of
words that hold them, rarest first. A word's prefix is its three rarest bigrams by place (more, if others tie with the third).
Of these, dynamic programming chooses two that don't overlap and are rarest together: the pivots. One edit can't touch both, so of
two near words the one whose third bigram comes first in the order has a pivot in the prefix of the other one.

Limits on places make the look-up narrow. If the edit lies behind the left pivot, everything up to and with it stands in both words
at the same place; if not, everything from the right pivot on does, as far from the end. Of what remains on the edited side, cut in
half, one half is whole too. So a pivot is looked up together with the text that an edit must have left whole and the length of
the other word. Candidates are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, pieces, stored

_LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A task holds so many words before it hands their counts on.
HELD_WORDS = 262_144
#: Bigrams of letters whose counts go to every task: 26 + 64 letters, and what a caller's own words hold, up to so many.
BIGRAMS = 1 << 20
_EDITS = (-1, 0, 1)


def word_counts(docs: DataFrame, noise: int = 199, min_length: int = 6, min_count: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of all words of at least so many code points and occurrences.

    Words are maximal runs of letters, only A-Z lower-cased. Where ``noise`` divides the crc32 of ``<id>:<run>``, one code point of
    the run is taken out (a null id is the empty text). Null texts have no words; each row of repeated ids counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part, data in pieces(batch, "text"):
                for i, x in zip(column(part, "doc_id").to_pylist(), data, strict=True):
                    begin = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for w, n in Counter(_LETTERS.findall(x.translate(_LOWER).decode("utf-8", "replace"))).items():
                        h = zlib.crc32(w.encode(), begin)
                        if h % noise == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                        if len(w) >= min_length:
                            held[w] += n
                if len(held) >= HELD_WORDS:
                    yield counts()
                    held.clear()
        yield counts()

    found = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def pivots(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """The places of the two grams of a prefix of (place, frequency), by rising place, that don't overlap and are rarest together."""
    best, chosen = None, (0, 0)  # of pairs so far
    alone: tuple[int, int] | None = None  # rarest gram that ends before the one at hand
    waiting: list[tuple[int, int]] = []
    for at, n in prefix:
        while waiting and waiting[0][1] + 2 <= at:
            alone = min(alone, waiting[0]) if alone else waiting[0]
            waiting.pop(0)
        if alone and (best is None or alone[0] + n < best):
            best, chosen = alone[0] + n, (alone[1], at)
        waiting.append((n, at))
    return chosen


def _prefix(word: str, frequency: dict[str, int]) -> tuple[list[tuple[int, int]], tuple[int, str]]:
    """Places and frequencies of a word's three rarest bigrams and those that tie with the third, and the third in the order."""
    grams = [((frequency[g], g), i) for i in range(len(word) - 1) for g in (word[i : i + 2],)]
    third = sorted(grams)[2][0]
    return [(i, g[0]) for g, i in grams if g <= third], third


def looked_up(word: str, at: int, end: int) -> list[str]:
    """What two look-ups of the word from both pivots ask for, for every length of a near word."""
    n = len(word)
    out = []
    for d in _EDITS:
        m = n + d
        half = (m - at - 2) // 2  # of the other word's text behind the left pivot
        out.append(f"{m}<{word[: at + 2 + half]}")
        out.append(f"{m}({word[: at + 2]}|{word[n - (m - at - 2 - half) :]}")
        half = (end + d) // 2  # of its text before the right pivot
        out.append(f"{m}>{word[:half]}|{word[end:]}")
        out.append(f"{m}){word[end - (end + d - half) :] if half <= end + d else ''}")
    return out


def offered(word: str, places: list[int]) -> set[str]:
    """What a word is found by: each gram of its prefix as left or as right pivot, with either half of what may be edited."""
    n = len(word)
    out = set()
    for at in places:
        half = (n - at - 2) // 2
        out |= {f"{n}<{word[: at + 2 + half]}", f"{n}({word[: at + 2]}|{word[at + 2 + half :]}"}
        half = at // 2
        out |= {f"{n}>{word[:half]}|{word[at:]}", f"{n}){word[half:]}"}
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs of near words of a table of distinct words (word, n), in both directions: word, near, near_n.

    Words need six code points at least (shorter ones and nulls have no pairs here); letters of any kind.
    """
    spark = words.sparkSession
    words = words.filter(F.char_length("word") >= 6)
    grams = words.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))).alias("gram"))
    counted = grams.groupBy("gram").count().limit(BIGRAMS + 1).collect()
    if len(counted) > BIGRAMS:
        raise ValueError("too many different letters")
    sent = spark.sparkContext.broadcast({r.gram: r["count"] for r in counted})

    def keys(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequency = sent.value
            for batch in batches:
                for begin in range(0, batch.num_rows, 2000):
                    part = batch.slice(begin, 2000)
                    row: list[int] = []
                    key: list[str] = []
                    rank: list[int] = []
                    last: list[str] = []
                    for i, w in enumerate(part.column(0).to_pylist()):
                        prefix, third = _prefix(w, frequency)
                        found = looked_up(w, *pivots(prefix)) if asked else offered(w, [at for at, _ in prefix])
                        key += found
                        row += [i] * len(found)
                        rank.append(third[0])
                        last.append(third[1])
                    at = pa.array(row, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), part.column(0).take(at), part.column(1).take(at), pa.array(rank, pa.int64()).take(at), pa.array(last, pa.string()).take(at)], ["key", "word", "n", "rank", "last"])

        spread = words.select("word", "n").mapInArrow(run, "key string, word string, n long, rank long, last string")
        return spread.select(F.xxhash64("key").alias("key"), "word", "n", F.struct("rank", "last").alias("third"))

    # Spark takes the size of these tables from the words' compressed file; they are many times as large, so they are never broadcast
    a, b = keys(True).alias("a"), keys(False).hint("merge").alias("b")
    verified: Column = F.levenshtein("a.word", "b.word", 1) == 1
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.third") <= F.col("b.third")) & verified)
    both = F.explode(F.array(F.struct(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")), F.struct(F.col("b.word").alias("word"), F.col("a.word").alias("near"), F.col("a.n").alias("near_n"))))
    return pairs.select(both.alias("pair")).select("pair.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a table word, form (each form of another word, without circles): the last word when forms are followed, by doubling steps."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reached.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = stored(step)
        reached = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return reached


def spelling_variants(docs: DataFrame, factor: int = 5, noise: int = 199, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each word with the frequent word that it may be a variant of: word, form, root, n, n_near, form_n.

    Of the near words that with the largest n (ties: smallest in code-point order) is the form, if it has ``factor`` times the
    word's n; root follows forms to the last one. Words without near words have n_near 0, those without form null form and form_n
    and themselves as root. Documents without words, null and empty texts add nothing; an empty table gives no rows.
    """
    words = stored(word_counts(docs, noise, id_col=id_col, text=text))
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = stored(words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best")).alias("best")).select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
