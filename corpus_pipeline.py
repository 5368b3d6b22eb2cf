"""A corpus pipeline: stages that each take the documents the stage before has kept.

Every stage but the last returns the columns of its documents. The stages are written and read again between each other by the
caller, or by ``run``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bpe_codec import bpe_round_trip
from sparkloom.llm.common import fold, fresh, stored, table
from sparkloom.llm.log_template import drop_recurring_lines
from sparkloom.llm.near_copies import drop_near_copies
from sparkloom.llm.queries import vocabulary
from sparkloom.llm.rank_order import UNKNOWN, identify_languages, language_profiles
from sparkloom.llm.template_leaks import drop_leaked, every_leak
from sparkloom.session import ship

#: Least similarity to the best profile; texts in none of the languages lie below.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; those without letters or like no profile go. All columns stay as they are."""
    ship(spark)
    rows = [tuple(r) for r in language_profiles(docs.filter(fold("doc_id", 3) != 1), "text", "lang").collect()]
    lang, score = fresh(docs, "_lang"), fresh(docs, "_score")
    found = identify_languages(docs, rows, docs.columns, names=(lang, score))
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rid of lines of recurring templates, n_chars set anew; those of which nothing is left go."""
    size, gone = fresh(docs, "_lines"), fresh(docs, "_dropped")
    cleaned = drop_recurring_lines(docs, names=(size, gone), runs=True)
    left = cleaned.filter((F.col(gone) == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    return left.select(*[F.when(F.col(gone) == 0, F.col(c)).otherwise(F.length("text")).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles: that of the smallest id. Rows without an id stay."""
    ship(spark)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return drop_leaked(docs, every_leak(docs, table(spark, sf_dir, "benchmark")))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    ship(spark)
    return bpe_round_trip(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_codec", bpe_codec),
]

#: SQL can't express profiles, fingerprints or the codec; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
