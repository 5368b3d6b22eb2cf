"""Text predicates, tokens and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the keyword index: the short list. Fixed values.
STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "in", "of", "to", "and", "or"]
#: Equation with operators, variable = expression, Greek letters and symbols. Fixed patterns.
FORMULA_PATTERNS = [r"[=\+\-\*/]\s*[A-Za-z]\s*[=\+\-\*/]", r"\b[A-Z][a-z]?\s*=\s*[A-Za-z0-9\+\-\*/\^\(\)]+", r"∫|∑|∂|√|∞|α|β|γ|δ|ε|θ|λ|μ|π|σ|τ|φ|ω"]
#: The last of them as one class of characters behind their ranges, which is five times as fast.
_SYMBOLS = r"[\x{3b1}-\x{3c9}\x{2202}-\x{222b}&&[∫∑∂√∞αβγδεθλμπστφω]]"
#: Headings by their numbering. Fixed values.
CHAPTER, SECTION, SUBSECTION = r"(?i)^chapter\s+(\d+)", r"^(\d+\.\d+)\s+(.+)$", r"^(\d+\.\d+\.\d+)\s+(.+)$"


def is_formula(text: Column) -> Column:
    a, b, c = (F.regexp_like(text, F.lit(p)) for p in (*FORMULA_PATTERNS[:2], _SYMBOLS))
    return a | b | c


def heading_kind(text: Column) -> Column:
    """chapter, subsection, section or null, by the numbering."""
    like = lambda p: F.regexp_like(text, F.lit(p))
    return F.when(like(CHAPTER), "chapter").when(like(SUBSECTION), "subsection").when(like(SECTION), "section")


def is_heading(text: Column, font_size: Column | None = None, font_name: Column | None = None) -> Column:
    """Large or short bold type, or a numbered heading."""
    big = F.coalesce(font_size > 13, F.lit(False)) if font_size is not None else F.lit(False)
    bold = F.coalesce(F.regexp_like(font_name, F.lit("[Bb]old")) & (F.length(text) < 120), F.lit(False)) if font_name is not None else F.lit(False)
    return big | bold | heading_kind(F.trim(text)).isNotNull()


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Tokens of a text, estimated by its words."""
    return F.size(words(text))


def keyword_tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower case, punctuation to blanks, words of two characters or more that are no stop words; all words if that leaves none."""
    every = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    some = lambda e: F.filter(e, lambda x: (F.length(x) > 1) & ~x.isin(stopwords))
    # as the one element of an array each list is worked out once
    return F.transform(F.array(every), lambda e: F.transform(F.array(some(e)), lambda s: F.when(F.size(s) > 0, s).otherwise(e))[0])[0]


def citation(chapter: Column, section: Column, subsection: Column, page: Column, page_end: Column) -> Column:
    head = F.concat_ws(" > ", chapter, F.nullif(section, F.lit("")), F.nullif(subsection, F.lit("")))
    pages = F.when(page == page_end, F.concat(F.lit("p."), page)).otherwise(F.concat(F.lit("pp."), page, F.lit("–"), page_end))
    return F.concat(head, F.lit(" ("), pages, F.lit(")"))


def keyword_recall(text: Column, keywords: Column) -> Column:
    """Share of the keywords that the text contains, in lower case; 0 without keywords."""
    low = F.lower(text)
    hits = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(F.lit(0.0))


def faithfulness(answer: Column, source: Column) -> Column:
    """Share of the answer's sentences of over 20 characters with a word trigram in the source; 0 without such sentences."""
    low = F.lower(source)
    sentences = F.filter(F.transform(F.split(answer, r"\."), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: F.length(s) > 20)

    def grounded(s: Column) -> Column:
        w = words(F.lower(s))
        grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))).otherwise(F.array().cast("array<string>"))
        return F.exists(grams, lambda g: F.contains(low, g))

    return F.when(F.size(sentences) > 0, F.size(F.filter(sentences, grounded)) / F.size(sentences)).otherwise(F.lit(0.0))


def source_trace(rerank: Column, rrf: Column, text: Column) -> Column:
    """(score, preview): a rerank score of 0 counts as none."""
    return F.struct(F.coalesce(F.nullif(rerank, F.lit(0.0)), rrf).alias("score"), F.concat(F.substring(text, 1, 150), F.lit("...")).alias("text_preview"))
