"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .bpe_codec import bpe_round_trip
from .class_ngram import class_bigram_scores
from .common import table
from .line_crf import quality_rules
from .log_template import drop_recurring_lines
from .piece_codec import piece_round_trip
from .pivotal_grams import spelling_variants
from .rank_order import languages
from .ranked_search import ranked_search
from .repeat_spans import remove_repeats
from .shrunk_qda import quality_scores
from .simhash import simhash_groups
from .template_leaks import template_leaks
from .token_counts import token_counts


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lambda s, d: class_bigram_scores(table(s, d, "documents")),
    "op2_token_counts": lambda s, d: token_counts(table(s, d, "documents"), vocabulary("byte_bpe_50k.json")),
    "op3_simhash": lambda s, d: simhash_groups(table(s, d, "documents")),
    "op4_quality_rules": lambda s, d: quality_rules(table(s, d, "documents"), table(s, d, "labels")),
    "op5_language_id": lambda s, d: languages(table(s, d, "documents")),
    "op6_quality_classifier": lambda s, d: quality_scores(table(s, d, "documents"), table(s, d, "labels")),
    "op7_repeat_spans": lambda s, d: remove_repeats(table(s, d, "documents")),
    "op8_line_dedup": lambda s, d: drop_recurring_lines(table(s, d, "documents")).select("doc_id", "n_lines", "n_dropped", "text"),
    "op9_decontamination": lambda s, d: template_leaks(table(s, d, "documents"), table(s, d, "benchmark")),
    "op10_bpe_codec": lambda s, d: bpe_round_trip(table(s, d, "documents"), vocabulary("word_bpe_49k.json")),
    "op11_ranked_search": lambda s, d: ranked_search(table(s, d, "documents"), table(s, d, "benchmark")),
    "op12_spelling_variants": lambda s, d: spelling_variants(table(s, d, "documents")),
    "op13_piece_codec": lambda s, d: piece_round_trip(table(s, d, "documents"), vocabulary("piece_bpe_32k.model")),
}

#: Of the operators that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op8_line_dedup": oracle.line_dedup(), "op9_decontamination": oracle.template_leaks(), "op11_ranked_search": oracle.ranked_search()}
