"""Operators 11 to 13: ranked search against all scores, near words against all pairs, the piece codec against its library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm_helpers import vocabulary
from pyspark.sql import functions as F

from sparkloom.llm import piece_codec as C
from sparkloom.llm import pivotal_grams as P
from sparkloom.llm import queries as Q
from sparkloom.llm import ranked_search as R

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"

# --- operator 11


def ranked(docs, items, k=10):
    """Scores of all documents for all items, term by term."""
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = [(i, Counter(find.findall((t or "").translate(lower)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None and t is not None:
            asked[i] |= set(find.findall(t.translate(lower)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_edges(spark, edge, no_docs):
    df, docs = edge
    items = [(1, "the SAME row, twice twice"), (2, "alpha beta. gamma"), (2, "river"), (3, None), (4, ""), (None, "alpha"), (5, "É日本語 naïve x"), (6, "no such thing")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = ranked(docs, items)
    assert rows(R.ranked_search(df, asked)) == want and len(want) == 5
    assert rows(R.ranked_search(df, asked, query_block=2)) == want  # more than one block: all terms are indexed
    assert R.ranked_search(no_docs, asked).count() == 0 == R.ranked_search(df, asked.limit(0)).count()


@pytest.mark.parametrize("segment", [300, 5_000, 10**7])
def test_search_equals_all_scores(spark, monkeypatch, segment):
    monkeypatch.setattr(R, "STRIDE", 128)
    rng = random.Random(segment)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(700)]
    docs += [(i + 700, t) for i, (_, t) in enumerate(docs[:200])]  # equal scores
    items = [(i, " ".join(rng.choices(words, weights, k=12))) for i in range(15)]
    got = R.ranked_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), segment_bytes=segment)
    assert rows(got) == ranked(docs, items)


def test_long_lists_are_skipped(spark):
    """Rare words decide the first ranks, so few postings of the frequent words are read."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(20)]
    docs = [(i, " ".join(rng.choices(common, k=40)) + (f" rare{i % 40}" * (1 + i % 3) if i % 5 == 0 else "")) for i in range(20_000)]
    segment = R.index_segments(spark.createDataFrame(docs, DOCS).coalesce(1), None).first().asDict()
    weight = {t: math.floor(1000 * math.log(40_002 / (2 * n + 1))) for t, n in zip(map(bytes, segment["terms"]), segment["dfs"], strict=True)}
    segment["terms"] = [bytes(t) for t in segment["terms"]]
    s = R.Segment(segment, weight, segment["n_docs"], segment["n_terms"])
    best = R.Best(10)
    terms = [b"rare5", *(c.encode() for c in common[:8])]
    s.search(terms, best)
    held = sum(len(s.lists[t][0]) for t in terms if t in s.row)
    assert held > 100_000 and s.read < held / 10
    assert [(1, n + 1, int(i), int(x)) for n, (i, x) in enumerate(zip(best.id, best.score, strict=True))] == sorted(ranked(docs, [(1, " ".join(t.decode() for t in terms))]), key=lambda r: r[1])


# --- operator 12


def edited(a, b):
    """One edit apart?"""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    near = {w: [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if edited(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@given(st.lists(st.text(alphabet="abé", min_size=6, max_size=9), min_size=2, max_size=40, unique=True))
@settings(max_examples=80, deadline=None, suppress_health_check=list(HealthCheck))
def test_pivots_miss_no_pair(words):
    frequency = Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
    prefix = {w: P._prefix(w, frequency) for w in words}
    offers = {w: P.offered(w, [at for at, _ in p]) for w, (p, _) in prefix.items()}
    for a in words:
        places, third = prefix[a]
        left, right = P.pivots(places)
        assert right >= left + 2
        assert frequency[a[left : left + 2]] + frequency[a[right : right + 2]] == min(n + m for i, n in places for j, m in places if j >= i + 2)
        asked = set(P.looked_up(a, left, right))
        for b in words:
            if edited(a, b) and third <= prefix[b][1]:
                assert asked & offers[b]


def test_variants_edges(spark, edge, no_docs):
    df, docs = edge
    chain = [(100 + i, w) for w, n in [("frequent", 900), ("frequnt", 150), ("frquent", 30), ("fraquent", 6), ("frequente", 150), ("Größere", 40), ("größre", 8), ("größ re", 9)] for i in range(n)]
    docs = docs + chain
    got = P.spelling_variants(df.select("doc_id", "text").unionByName(spark.createDataFrame(chain, DOCS)))
    want = variants(docs)
    assert found(got) == want
    form = {r[0]: r[1:3] for r in want}
    assert form["frquent"] == ("frequent", "frequent") and form["fraquent"] == ("frequent", "frequent") and form["größre"] == ("größere", "größere")
    assert P.spelling_variants(no_docs).count() == 0


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w9")], "word string, form string")
    assert {r.root for r in P.roots(forms).collect()} == {"w11"} and P.roots(forms.limit(0)).count() == 0


def test_word_tables_are_not_broadcast(spark, tmp_path):
    """A small compressed file of words says little of the many entries made of it."""
    spark.range(3000).select(F.concat(F.lit("someword"), F.col("id").cast("string")).alias("word"), F.lit(5).alias("n")).write.parquet(str(tmp_path / "words"))
    plan = P.near_pairs(spark.read.parquet(str(tmp_path / "words")))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_variants_equal_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = variants(docs)
    assert found(Q.QUERIES["op12_spelling_variants"](spark, DATA)) == want
    assert sum(r[1] is not None for r in want) > 10


# --- operator 13

ODD = st.text(alphabet="aeint hTo 'sdreÉßΣ中😀1٣½.,!_#<>=(){}/\\▁\n\t\x1c\x85 ", max_size=60)


@pytest.fixture(scope="module")
def library():
    lib = pytest.importorskip("sentencepiece")
    return lib.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


@given(st.one_of(ODD, st.sampled_from(["<s>a</s>", "<0x0A>", "    def f(x):\n        return x", "aaaaaaaaaaaa", "▁ ▁▁", "http://a.b/c?d=e", "    ", "﻿"])))
@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
def test_pieces_equal_the_library(library, text):
    c = C.piece_codec(vocabulary("piece_bpe_32k.model"))
    ids = library.encode(text)
    assert c.encode(text).tolist() == ids
    assert c.decode(np.array(ids, "<u4")) == library.decode(ids)
    run = text.replace(" ", C.SPACE)
    assert c.merged(run) == list(c.merged_by_heap(run))


@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 260), st.sampled_from([0, 1, 2, 259, 13 + 3])), max_size=9))
@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
def test_any_ids_are_decoded_as_by_the_library(library, ids):
    assert C.piece_codec(vocabulary("piece_bpe_32k.model")).decode(np.array(ids, "<u4")) == library.decode(ids)


def test_piece_edges(spark, edge, no_docs, library):
    df, docs = edge
    path = vocabulary("piece_bpe_32k.model")
    want = []
    for i, t in docs:
        ids = library.encode(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = C.piece_round_trip(df, path).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert C.piece_round_trip(df, path, digests=False).filter("doc_id = 8").first().decoded == "one"
    assert C.piece_round_trip(no_docs, path).count() == 0 == C.library_differences(df, path).count()


def test_whole_documents_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    unbroken = spark.createDataFrame([(-1, "thequickbrownfox" * 4000), (-2, " " * 3001), (-3, "é" * 999 + "=" * 5000)], DOCS)
    assert C.library_differences(docs.unionByName(unbroken), vocabulary("piece_bpe_32k.model")).count() == 0


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(b"\x0a\x0b\x0a\x01a\x15\x00\x00\x00\x00\x18\x01\x20\x00" + b"\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        C.PieceCodec(str(path))
