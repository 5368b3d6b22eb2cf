"""Operator 9: benchmark decontamination by template canonicalisation, with DataFrame functions only.

Words become canonical: numbers, quantities, units and names (capitals within a sentence) turn into typed placeholders, others lose
case and outer punctuation. Windows of canonical words of documents and benchmark items meet in a hash join; hits on one diagonal (document
position less item position) are one passage. Its slots, the words behind the placeholders, must be consistent: each value of
the item answers to one value of the document throughout, so a question with other numbers is caught; windows without a literal word
don't count, so a chance meeting of placeholders isn't. A passage that covers ``coverage`` of an item's windows is a leak.

With ``shifts`` a run of placeholders of one type is one slot, hits on neighbouring diagonals are one passage, and of a passage only
the windows with a minority value of a slot are left out; so values of another number of words, and some words put in or left
out, don't break a passage up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: Units as whole words. Fixed values.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "usd", "eur", "dollars", "euros", "cents", "percent", "miles", "feet", "inches", "pounds", "meters", "metres", "liters", "litres", "degrees"]
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
#: Outer punctuation: no letter, digit, money or percent sign, and none of the two marks below.
_PUNCT = r"[^\p{L}\p{N}\x20\x09-\x0D$%€£\x01\x02]"
_NUMBER = r"[0-9]++(?:[.,:/-][0-9]++)*+"
#: Placeholders: a mark and the type, then another mark and the word that stood there.
_TYPES = [
    ("name", rf"(?<=[^.!?:;\x20\x09-\x0D][\x20\x09-\x0D]){_PUNCT}*+(\p{{Lu}}\p{{Ll}}{_WORD}*+)"),
    ("number", rf"(?<!{_WORD}){_PUNCT}*+({_NUMBER}){_PUNCT}*+(?!{_WORD})"),
    ("quantity", rf"(?<!{_WORD}){_PUNCT}*+([$€£]?{_NUMBER}[\p{{L}}%$€£]{{0,4}}+){_PUNCT}*+(?!{_WORD})"),
    ("unit", rf"(?<=[0-9][\x20\x09-\x0D])((?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![\p{{L}}\p{{N}}])"),
]
_OUTER = rf"(?<!{_WORD}){_PUNCT}++|(?<!{_PUNCT}){_PUNCT}++(?!{_WORD})"
#: Most benchmark windows that are sent to every executor; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Diagonals of one passage lie no further apart than so many words and the item's slots.
SLACK = 4


def _canonical(text: Column, runs: bool = False) -> Column:
    """The text in canonical words; a placeholder is followed by the word that stood there. All passes are over the whole text.

    ``runs``: placeholders of one type that follow each other become one, followed by all their words.
    """
    kind, pattern = _TYPES[0]
    out = F.regexp_replace(text, pattern, f"\u0002{kind}\u0001$1")
    for kind, pattern in _TYPES[1:]:
        out = F.regexp_replace(out, pattern, f"\u0002{kind}\u0001$1")
    out = F.when(F.regexp_like(text, F.lit("[0-9]")), out).otherwise(F.regexp_replace(text, _TYPES[0][1], f"\u0002{_TYPES[0][0]}\u0001$1"))
    out = F.regexp_replace(F.lower(out), _OUTER, "")
    for kind in [k for k, _ in _TYPES] if runs else []:
        out = F.regexp_replace(out, rf"(\x02{kind}\x01|\G(?<!^))([^\x20\x09-\x0D\x02]*+){_SPACE}\x02{kind}\x01", "$1$2\u0003")
    return out


def _words(text: Column, runs: bool = False) -> Column:
    return F.array_remove(F.split(_canonical(text, runs), _SPACE), "")


def _windows(rows: DataFrame, keys: list[str], widths: list[int | Column]) -> DataFrame:
    """keys, at, h (hash of the window's canonical words), slots (the words behind its placeholders), of every window of the words w."""
    words = rows.select(*keys, "w")
    # arrays that lambdas look into are columns of their own that are used at least twice: such columns the optimizer leaves
    # apart, where it would put the array's expression into the lambda and work it out for every element
    apart = words.select(*keys, F.transform("w", lambda x: F.xxhash64(F.substring_index(x, "\u0001", 1))).alias("c"), F.transform("w", lambda x: F.when(F.instr(x, "\u0001") > 0, F.substring_index(x, "\u0001", -1))).alias("v"), F.exists("w", lambda x: F.instr(x, "\u0001") > 0).alias("any"))

    def of(width: int | Column) -> Column:
        last = F.size("c") - width
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("c", i + 1, width)).alias("h"), F.when(F.col("any"), F.array_join(F.slice("v", i + 1, width), "\u0001")).otherwise(F.lit("")).alias("slots")))
        return F.when((last >= 0) & (F.size("v") == F.size("c")), each)

    every = F.flatten(F.array_compact(F.array(*[of(w) for w in widths]))) if len(widths) > 1 else of(widths[0])
    return apart.select(*keys, F.explode(every).alias("x")).select(*keys, "x.*")


def template_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", width: int = 6, coverage: float = 0.3, min_words: int = 4, shifts: bool = False) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, exact) of every pair whose document holds a passage of the item.

    Windows of placeholders alone are neither looked for nor counted, so items of nothing else give no pair.
    n_windows and coverage are of the pair's best passage; exact: all its slots have the item's own values. Items under ``width``
    words are looked for as one window; under ``min_words`` words not at all, as a bare phrase says nothing; words are canonical
    ones, of ``shifts`` too. An item of one window is also looked for with its first word as a name. Null ids and null and
    empty texts give no pair; rows of equal id are one document or item. Other columns are not read.
    """
    texts = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).filter("item_id is not null and text is not null")
    # the first word as within a sentence
    inner = F.concat(F.lit("x "), F.regexp_replace("text", rf"^{_SPACE}", ""))
    forms = texts.select("item_id", _words(F.col("text"), shifts).alias("w"), _words(inner, shifts).alias("v")).filter(F.size("w") >= min_words)
    plain = forms.select("item_id", "w")
    named = forms.filter(F.size("w") <= width).select("item_id", F.slice("v", 2, F.size("v")).alias("w")).filter(F.size("w") >= min_words)
    items = plain.unionByName(named).withColumn("width", F.least(F.size("w"), F.lit(width))).withColumn("slack", SLACK + F.size(F.filter("w", lambda x: F.instr(x, "\u0001") > 0)))
    short = sorted(r[0] for r in items.filter(F.col("width") < width).select("width").distinct().collect())
    own = _windows(items, ["item_id", "width", "slack"], [F.col("width")])
    # windows of placeholders alone say nothing
    slots = F.when(F.col("slots") == "", 0).otherwise(F.size(F.split("slots", "\u0001")))
    own = own.filter(slots < F.col("width"))
    asked = own.groupBy("item_id", F.col("at").alias("q"), "h", F.col("slots").alias("theirs")).agg(F.max("slack").alias("slack"))
    total = asked.groupBy("item_id").agg(F.countDistinct("q").alias("total"))
    n = asked.count()
    told = F.broadcast(asked) if n <= BROADCAST_WINDOWS else asked
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    hits = _windows(texts.select("doc_id", _words(F.col("text"), shifts).alias("w")), ["doc_id"], [*short, width]).join(told, "h")
    # of a diagonal: how many of the item's windows, and its slots as pairs of item and document value
    slot = F.arrays_zip(F.split("theirs", "\u0001").alias("i"), F.split("slots", "\u0001").alias("d"))
    by = hits.select("doc_id", "item_id", (F.col("at") - F.col("q")).alias("diagonal"), "q", F.when(F.col("theirs") != "", slot).otherwise(F.array().cast("array<struct<i:string,d:string>>")).alias("slot"), "slack")
    if shifts:
        passages = _passages(by).join(F.broadcast(total) if n <= BROADCAST_WINDOWS else total, "item_id").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= coverage)
        return passages.groupBy("doc_id", "item_id").agg(F.max("n").cast("long").alias("n_windows"), F.max("share").alias("coverage"), F.max("exact").alias("exact"))
    by = by.groupBy("doc_id", "item_id", "diagonal").agg(F.countDistinct("q").alias("n"), F.array_distinct(F.flatten(F.collect_set("slot"))).alias("slot"))
    consistent = F.size("slot") == F.size(F.array_distinct(F.col("slot.i")))
    found = by.filter(consistent).join(F.broadcast(total) if n <= BROADCAST_WINDOWS else total, "item_id").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= coverage)
    exact = ~F.exists("slot", lambda x: x["i"] != x["d"])
    return found.groupBy("doc_id", "item_id").agg(F.max("n").cast("long").alias("n_windows"), F.max("share").alias("coverage"), F.max(exact).alias("exact"))


def _passages(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, passage, n, exact) of the hits of neighbouring diagonals: n windows without minority values of their slots."""
    pair = Window.partitionBy("doc_id", "item_id")
    jump = (F.col("diagonal") - F.lag("diagonal").over(pair.orderBy("diagonal")) > F.col("slack")).cast("int")
    cut = hits.distinct().withColumn("jump", F.coalesce(jump, F.lit(0)))
    of = cut.withColumn("passage", F.sum("jump").over(pair.orderBy("diagonal").rangeBetween(Window.unboundedPreceding, 0)))
    one = ["doc_id", "item_id", "passage"]
    slots = of.select(*one, "diagonal", "q", F.explode_outer("slot").alias("x")).select(*one, "diagonal", "q", "x.i", "x.d").distinct()
    votes = slots.withColumn("votes", F.count("*").over(Window.partitionBy(*one, "i", "d")))
    top = votes.withColumn("top", F.max(F.struct("votes", "d")).over(Window.partitionBy(*one, "i"))["d"])
    whole = top.groupBy(*one, "diagonal", "q").agg(F.min(F.coalesce(F.col("d") == F.col("top"), F.lit(True))).alias("kept"), F.min(F.coalesce(F.col("i") == F.col("d"), F.lit(True))).alias("same"))
    return whole.filter("kept").groupBy(*one).agg(F.countDistinct("q").alias("n"), F.min("same").alias("exact"))


def every_leak(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", min_words: int = 4) -> DataFrame:
    """``template_leaks`` with ``shifts``; items whose runs leave too few words for it are looked for without."""
    leaks = template_leaks(docs, benchmark, id_col, item_col, text, min_words=min_words, shifts=True)
    few = benchmark.filter((F.size(_words(F.col(text).cast("string"), True)) < min_words) & (F.size(_words(F.col(text).cast("string"))) >= min_words))
    return leaks if few.isEmpty() else leaks.unionByName(template_leaks(docs, few, id_col, item_col, text, min_words=min_words))


def drop_leaked(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that hold a leak."""
    i = fresh(docs, "_id")
    gone = leaks.select(F.col("doc_id").alias(i)).distinct()
    return docs.join(gone, F.col(i) == F.col(id_col).cast("long"), "left_anti")
