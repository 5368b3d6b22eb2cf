"""Operators 2, 3, 7 and 10: against the libraries and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm_helpers import vocabulary
from pyspark.sql import functions as F

from sparkloom.llm import bpe_codec as B
from sparkloom.llm import repeat_spans as S
from sparkloom.llm import simhash as H
from sparkloom.llm import token_counts as T
from sparkloom.llm.components import connected_components

ODD = st.text(alphabet="aeint hTo 'sdreÉßİΣσ中😀12٣½.,!_#<|endoftext>\n\t\x1c\x85 ", max_size=60)


@pytest.fixture(scope="module")
def tokenizers():
    lib = pytest.importorskip("tokenizers")
    return {n: lib.Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@given(st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", "a<|endoftext|> <|startoftext|>b", "aaaaaaa", "they'll", "   "])), max_size=8))
@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
def test_counts_and_codec_equal_the_library(tokenizers, texts):
    a, b = tokenizers.values()
    assert T.merge_table(vocabulary("byte_bpe_50k.json")).count(texts) == [len(e.ids) for e in a.encode_batch(texts, add_special_tokens=False)]
    c = B.codec(vocabulary("word_bpe_49k.json"))
    for t in texts:
        ids = b.encode(t, add_special_tokens=False).ids
        mine = c.encode(t)
        assert np.frombuffer(mine, "<u4").tolist() == ids
        assert c.decode(mine).decode() == b.decode(ids, skip_special_tokens=False)


def test_token_edges(spark, edge, no_docs, tokenizers):
    df, rows = edge
    a, b = tokenizers.values()
    got = T.token_counts(df, vocabulary("byte_bpe_50k.json"), limit=100).collect()
    want = [(i or -1, len((t or "").encode()), n, n > 100) for i, t in rows for n in [len(a.encode(t or "", add_special_tokens=False).ids)]]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)
    got = B.bpe_round_trip(df, vocabulary("word_bpe_49k.json")).collect()
    want = []
    for i, t in rows:
        ids = b.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(b.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert B.bpe_round_trip(df, vocabulary("word_bpe_49k.json"), digests=False).filter("doc_id = 8").first().decoded == "one</w>"
    assert T.token_counts(no_docs, vocabulary("byte_bpe_50k.json")).count() == 0 == B.bpe_round_trip(no_docs, vocabulary("word_bpe_49k.json")).count()


# --- operator 3


def brute_fp(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_roots(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = sorted(parent)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fs}


@pytest.mark.parametrize("block", [512, 3])
def test_links_connect_what_all_pairs_do(spark, block):
    rng = random.Random(8)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.randint(0, 12)):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << bit
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = connected_components(H.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block))
    root = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in found.collect()}
    want = brute_roots(fps)
    groups = lambda of: sorted(sorted(f for f in fps if of.get(f, f) == k) for k in {of.get(f, f) for f in fps})
    assert groups(root) == groups(want)


def test_simhash_of_documents(spark, edge, no_docs):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(200)]
    rows = list(edge[1])
    for g in range(12):
        words = [rng.choice(vocab) for _ in range(rng.choice([2, 40, 300]))]
        for c in range(rng.randint(1, 5)):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((100 + 10 * g + c, " ".join(w).upper()))
    got = H.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [(i, brute_fp(t)) for i, t in rows]
    root = brute_roots({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i if i is not None else -1, f"{f:016x}", least.get(root[f], -1)) for i, f in fps]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == sorted(want)
    assert H.simhash_groups(edge[0]).count() == len(edge[1])
    # another id column, beside columns of the names used inside
    keyed = edge[0].withColumns({"key": F.col("doc_id") * 10, "a": F.lit("clash")})
    assert {r.doc_id for r in H.simhash_groups(keyed, id_col="key").collect()} == {None if i is None else i * 10 for i, _ in edge[1]}
    assert H.simhash_groups(no_docs).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(i, 100) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


# --- operator 7


def brute_cut(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(b for b, c in zip(t, cover) if not c)
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("crowd", "by_bytes"), [(256, False), (256, True), (10, False), (1, True)])
def test_repeats_against_all_windows(spark, edge, no_docs, crowd, by_bytes):
    rng = random.Random(10)
    text = lambda n, al="abc \n": "".join(rng.choice(al) for _ in range(n))
    shared, wide = text(450), "é" * 500
    rows = [*edge[1], (20, shared), (21, text(50) + shared[:399]), (22, text(60) + shared[10:430] + text(80)), (23, wide), (24, "a" * 401), (25, shared + text(900) + shared), (26, text(399)), (27, "a" * 400)]
    rows += [(50 + i, text(rng.randint(0, 500)) + shared[rng.randint(0, 60) : rng.randint(380, 450)] + text(rng.randint(0, 200))) for i in range(40)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd, by_bytes=by_bytes).collect()
    want = [(i or -1, *b) for (i, _), b in zip(rows, brute_cut([(t or "").encode() for _, t in rows], 400))]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    if crowd == 10:
        assert S.remove_repeats(edge[0]).count() == len(edge[1])
        assert S.remove_repeats(no_docs).count() == 0
        kept = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in S.remove_repeats(spark.createDataFrame([(1, shared), (2, "x" + shared), (3, "other")], "doc_id long, text string"), digests=False).collect()}
        assert kept == {1: "", 2: "x", 3: "other"}


def test_passages_against_all_word_windows(spark):
    """Passages of over 50 words are reported whatever their bytes and spacing."""
    rng = random.Random(12)
    vocab = [f"{rng.choice('abcdefgh')}{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = text(70)
    rows = [(i, " ".join(text(rng.randint(0, 90)) + shared[rng.randint(0, 10) : rng.randint(55, 70)] + text(rng.randint(0, 40)))) for i in range(40)]
    rows += [(40, "\n".join(shared[:51])), (41, " ".join(shared[:50])), (42, " ".join(text(300))), (43, None), (44, " ".join(shared[:60]) + "  " + " ".join(shared[:60])), (45, "x " * 60)]
    count = Counter(tuple(w[i : i + 51]) for _, t in rows for w in [(t or "").split()] for i in range(len(w) - 50))

    def brute(t):
        w = (t or "").split()
        return len({i + k for i in range(len(w) - 50) if count[tuple(w[i : i + 51])] > 1 for k in range(51)})

    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_passage_words for r in got.collect()} == {i: brute(t) for i, t in rows}


@given(st.integers(0, 10**6), st.integers(2, 14), st.integers(4, 9))
@settings(max_examples=40, deadline=None)
def test_columns_against_brute_force(seed, rows, length):
    rng = np.random.default_rng(seed)
    m = rng.integers(0, 2, (rows, 24)).astype(np.int16)
    for i in range(rows):
        m[i, : rng.integers(0, 8)] = -1
        m[i, 24 - rng.integers(0, 8) :] = -1
    group = np.sort(rng.integers(0, 3, rows))
    got = S.repeated_columns(m, group, length)
    for i in range(rows):
        for b in range(24 - length + 1):
            w = m[i, b : b + length]
            want = (w >= 0).all() and any(j != i and group[j] == group[i] and (m[j, b : b + length] == w).all() for j in range(rows))
            assert got[i, b] == want


def test_long_documents_are_cut_in_segments(monkeypatch):
    monkeypatch.setattr(S, "_SEGMENT", 1000)
    rng = np.random.default_rng(11)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    whole = {(int(p), int(x)) for p, lo, hi, _ in zip(*S.anchors_of(data, 400)) for x in range(lo, hi + 1)}
    parts = set()
    for s in range(0, 5000 - 399, 1000):
        p, lo, hi, _ = S.anchors_of(data[s : s + 1000 + 399], 400)
        parts |= {(int(a) + s, int(x) + s) for a, b, c in zip(p, lo, hi) for x in range(b, c + 1)}
    assert parts == whole
