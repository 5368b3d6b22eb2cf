"""Operator 8: line dedup by a log-template tree (after Drain), with DataFrame functions only.

A line's words, those with a digit masked, walk down a tree of fixed depth: by word count, then by the leading words. Lines that
reach the same leaf share a template: at each place the leaf's most common word. A line close enough to it belongs to it, its
differing words being variable fields; any other line is its own template. A template recurs when it stands in at least
``min_docs`` documents and between at least that many, and ``min_spread`` times its documents, different pairs of neighbouring
lines; so a notice set into many texts recurs, while the lines of copied documents, whose neighbours are the same in every
copy, don't and are left to near-duplicate removal. Lines of recurring templates are dropped everywhere.

With ``runs`` a template also recurs by the texts around the whole run of candidate lines it is in, so that the inner lines of a
notice of several lines count as its outer ones do. There equal texts count once, and texts that are the same but for the run and
some changed words mostly count once: a text stands for the least and greatest hash of its word pairs outside the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

_SPACE = r"[\x20\x09-\x0D]+"
#: A word with a digit. It begins after white space or at the start, so that long words are read once.
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _masked(text: str = "text") -> Column:
    """The text with words that hold a digit masked; most texts have no digit and stay as they are."""
    return F.when(F.regexp_like(text, F.lit("[0-9]")), F.regexp_replace(text, _VARIABLE, "<*>")).otherwise(F.col(text))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, _SPACE), "")


def template_lines(docs: DataFrame, leading: int, min_words: int) -> DataFrame:
    """(doc_id, th, at, leaf, line, place) of each line with at least ``min_words`` words; hashes only, no text.

    (doc_id, th) tells documents apart, th being the text's hash; at is the line's number, line the masked line's hash, leaf its
    leaf's, place that of its neighbours.
    """
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split(_masked(), "\n").alias("lines"))
    # the first words and the count, without cutting the rest of the line into words
    lead = lambda x: F.slice(F.split(F.regexp_replace(x, r"^[\x20\x09-\x0D]+", ""), _SPACE, leading + 1), 1, leading)
    parsed = each.select("doc_id", "th", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]++")).alias("n"), lead(x).alias("w"))).alias("p"))
    short = parsed.select("doc_id", "th", F.transform("p", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), F.xxhash64(x["n"], x["w"]).alias("leaf"))).alias("p"))
    rows = short.select("doc_id", "th", F.posexplode(F.transform("p", lambda x, i: F.struct(x["n"].alias("n"), x["leaf"].alias("leaf"), x["line"].alias("line"), F.xxhash64(F.get("p", i - 1)["line"], F.get("p", i + 1)["line"]).alias("place")))).alias("at", "x"))
    return rows.filter(F.col("x.n") >= min_words).select("doc_id", "th", "at", "x.leaf", "x.line", "x.place")


def recurring_lines(docs: DataFrame, lines: DataFrame, leading: int, min_words: int, similarity: float, min_docs: int, min_spread: float, runs: bool = False) -> DataFrame:
    """(leaf, line) of the distinct masked lines whose template recurs."""
    # leaves that enough documents reach; partial sums keep a hot leaf out of any one task
    wide = stored(lines.select("leaf", "doc_id", "th").distinct().groupBy("leaf").count().filter(F.col("count") >= min_docs).select("leaf"))
    near = lines.join(wide, "leaf", "left_semi")
    kinds = near.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at")).alias("seen"))
    # the words of each distinct line, from the first document that has it
    wanted = kinds.select("leaf", "line", "n", F.col("seen.doc_id").alias("doc_id"), F.col("seen.th").alias("th"), F.col("seen.at").alias("at")).groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "leaf", "line", "n")).alias("want"))
    text = docs.withColumn("th2", F.xxhash64("text")).alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id and d.th2 = w.th")).select("text", "want", "w.doc_id", "th").dropDuplicates(["doc_id", "th"])
    # arrays that a lambda looks into are used twice, or the optimizer would work them out for every element
    split = text.select("want", F.split(_masked(), "\n").alias("lines"))
    words = split.select(F.explode(F.when(F.size("lines") > 0, F.transform("want", lambda x: F.struct(x["leaf"].alias("leaf"), x["line"].alias("line"), x["n"].alias("n"), _words(F.get("lines", x["at"])).alias("w"))))).alias("x")).select("x.*")
    words = stored(words)
    tokens = words.select("leaf", "line", "n", F.posexplode("w").alias("i", "word"))
    # each place's most common word of the leaf; of equals the last in order of bytes
    common = tokens.groupBy("leaf", "i", "word").agg(F.sum("n").alias("n")).groupBy("leaf", "i").agg(F.max_by("word", F.struct("n", F.col("word"))).alias("top"))
    same = tokens.join(common.select("leaf", "i", "top"), ["leaf", "i"]).groupBy("leaf", "line").agg(F.avg((F.col("word") == F.col("top")).cast("double")).alias("like"))
    template = F.when(F.col("like") >= similarity, F.lit(0).cast("long")).otherwise(F.col("line"))
    # stored, so that Spark can deal out a hot line in the joins, as it can't below an aggregation
    of = stored(same.select("leaf", "line", template.alias("template")))
    members = near.join(of, ["leaf", "line"])
    documents = members.select("leaf", "template", "doc_id", "th").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs"))
    places = members.select("leaf", "template", "place").distinct().groupBy("leaf", "template").agg(F.count("*").alias("places"))
    often = documents.join(places, ["leaf", "template"]).filter((F.col("docs") >= min_docs) & (F.col("places") >= min_docs) & (F.col("places") >= min_spread * F.col("docs")))
    out = of.join(often.select("leaf", "template"), ["leaf", "template"], "left_semi").select("leaf", "line")
    return out.unionByName(_recurring_in_runs(docs, lines, of, min_docs, min_spread)).distinct() if runs else out


def _recurring_in_runs(docs: DataFrame, lines: DataFrame, of: DataFrame, min_docs: int, min_spread: float) -> DataFrame:
    """(leaf, line) of the distinct lines whose template stands, in runs of candidate lines, in enough different texts."""
    members = lines.select("doc_id", "th", "at", "leaf", "line").join(of, ["leaf", "line"])
    enough = members.select("leaf", "template", "th").distinct().groupBy("leaf", "template").count().filter(F.col("count") >= min_docs)
    # one document of each different text
    marked = members.join(enough.select("leaf", "template"), ["leaf", "template"], "left_semi")
    first = marked.groupBy("th").agg(F.min("doc_id").alias("doc_id"))
    marked = stored(marked.alias("m").join(first.alias("f"), F.expr("m.th = f.th and m.doc_id <=> f.doc_id")).select("m.doc_id", "m.th", "at", "leaf", "template").distinct())
    hosts = marked.select(F.col("doc_id").alias("i"), F.col("th").alias("t")).distinct()
    text = docs.withColumn("th", F.xxhash64("text")).join(hosts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left_semi").dropDuplicates(["doc_id", "th"])
    each = text.select("th", F.posexplode(F.split(_masked(), "\n")).alias("at", "l")).select("th", "at", _words(F.col("l")).alias("w"))
    pairs = each.select("th", "at", F.size("w").alias("n"), F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.xxhash64(a, b)).alias("h"))
    known = pairs.filter("n > 1").select("th", "at", F.array_min("h").alias("low"), F.array_max("h").alias("high")).join(marked.select("th", "at", "leaf", "template"), ["th", "at"], "left")
    within = Window.partitionBy("th")
    runs = known.withColumn("run", F.when(F.col("template").isNotNull(), F.sum(F.col("template").isNull().cast("int")).over(within.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))))
    # of the text outside a run: all other lines, and all other runs
    per = runs.groupBy("th", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_set(F.when(F.col("run").isNotNull(), F.struct("leaf", "template"))).alias("of"))
    order = within.orderBy("run")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    outside = per.select("th", "of", F.least(F.min("low").over(before), F.min("low").over(after)).alias("low"), F.greatest(F.max("high").over(before), F.max("high").over(after)).alias("high"))
    places = outside.filter("low is not null").select("th", "low", "high", F.explode("of").alias("x")).select("x.leaf", "x.template", "th", "low", "high")
    count = lambda c: places.select("leaf", "template", c).distinct().groupBy("leaf", "template").agg(F.count("*").alias(f"n_{c}"))
    often = count("th").join(count("low"), ["leaf", "template"]).join(count("high"), ["leaf", "template"])
    least = F.least("n_low", "n_high")
    often = often.filter((least >= min_docs) & (least >= min_spread * F.col("n_th")))
    return of.join(often.select("leaf", "template"), ["leaf", "template"], "left_semi").select("leaf", "line")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", leading: int = 3, min_words: int = 3, similarity: float = 0.7, min_docs: int = 5, min_spread: float = 0.5, names: tuple[str, str] = ("n_lines", "n_dropped"), runs: bool = False) -> DataFrame:
    """``docs`` with ``text`` rid of the lines of recurring templates, and the counts of its lines and of those dropped added under ``names`` (columns of those names are replaced).

    Null and empty texts stay as they are (0 and 1 lines); texts that lose all their lines become empty. Rows with equal id and text
    count as one document and get the same result; null ids are told apart by their texts. Other columns pass through.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lines = stored(template_lines(own, leading, min_words))
    out = stored(recurring_lines(own, lines, leading, min_words, similarity, min_docs, min_spread, runs))
    rest = docs.drop(*names)
    i, th, drop, lines_of = (fresh(rest, n) for n in ("_id", "_th", "_drop", "_body"))
    drops = lines.join(out, ["leaf", "line"], "left_semi").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("at")).alias(drop)).withColumnsRenamed({"doc_id": i, "th": th})
    joined = rest.join(drops, F.col(i).eqNullSafe(F.col(id_col).cast("long")) & (F.col(th) == F.xxhash64(F.col(text).cast("string"))), "left").withColumn(lines_of, F.split(F.col(text).cast("string"), "\n"))
    size = F.coalesce(F.size(lines_of), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col(drop))
    cleaned = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines_of, i)), "\n"))
    columns = [cleaned.alias(text) if c == text else F.col(c) for c in rest.columns]
    return joined.select(*columns, F.when(F.col(text).isNull(), 0).otherwise(size).cast("long").alias(names[0]), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(names[1]))
