"""Operators 1, 4, 5 and 6: against brute force, and for what they must catch."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import class_ngram as N
from sparkloom.llm import line_crf as C
from sparkloom.llm import rank_order as R
from sparkloom.llm import shrunk_qda as Q


def prose(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(t):
    return WORDS.findall((t or "").encode().lower())


def fold(i, k):
    return zlib.crc32(str(i).encode() if i is not None else b"") % k


@pytest.fixture(scope="module")
def corpus(spark):
    """Two kinds of text whose words follow each other by kind."""
    rng = random.Random(3)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, prose(rng, rng.randint(5, 60), (a, b)[i % 2]) + f" rare{i}") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def base_scores(rows):
    train = Counter()
    for i, t in rows:
        if fold(i, 10):
            train.update([*tokens(t), None])
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        w = [*tokens(t), None]
        out.append((i, fold(i, 10) == 0, len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    return out


@pytest.mark.parametrize("head", [N.HEAD, 20])
def test_base_score_is_exact(spark, corpus, monkeypatch, head):
    """With all words held by the workers, and with most of them joined."""
    monkeypatch.setattr(N, "HEAD", head)
    df, rows = corpus
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in N.class_bigram_scores(df, words=40, forms=20, classes=6).collect()]
    assert sorted(got) == sorted(base_scores(rows))


def test_head_and_joined_words_score_alike(spark, corpus, monkeypatch):
    df, _ = corpus
    run = lambda: {r.doc_id: r.score for r in N.class_bigram_scores(df, words=10, forms=20, classes=6).collect()}
    a = run()
    monkeypatch.setattr(N, "HEAD", 20)
    b = run()
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_scoring_holds_little_beside_a_batch():
    """A batch of 8 MB of text is scored in small pieces, whatever its size: a worker takes less than 5 bytes for each of its bytes."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = random.Random(5)
    words_of = [b"w%d" % i for i in range(1000)]
    head = [(w, 5, 1 + i % 3) for i, w in enumerate(words_of[:900])]
    grid = np.ones((4, 4))
    model = N.Model(np.array([1, 2, 3]), grid, grid.sum(0), np.ones(4), head, 5000, 1001, 10, 20.0)
    docs = [b" ".join(rng.choices(words_of, k=400)).decode() for _ in range(4200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(range(len(docs))), pa.array([False] * len(docs)), pa.array(docs)], ["rid", "doc_id", "held_out", "text"])
    size, n = batch.column(3).nbytes, 0
    assert size > 8_000_000
    tracemalloc.start()
    try:
        for part in N._score(SimpleNamespace(value=model))(iter([batch])):
            n += sum(x or 0 for x in part.column(part.schema.get_field_index("n_tokens")).to_pylist())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 4200 * 401 and most < 5 * size


def test_words_are_those_of_bytes_split():
    """Odd bytes, blanks of all kinds and other controls; and what is made of the words: their places, endings and units."""
    docs = [b"", b" \n\t ", b" a  B\x0bcd\x0ce\xff\xfeF \x1cg\x00h \xc2\x85x\xa0 ", "ſ É Ünïcode z".encode(), b"one", b"x\r\ny a"]
    each = [d.lower().split() for d in docs]
    flat = [w for x in each for w in x]
    got, ends = N.words_of(docs)
    assert got.to_pylist() == N.apart(got) == flat and ends.tolist() == np.cumsum([len(x) for x in each]).tolist()
    assert N.apart(got[:0]) == [] and len(N.forms_of(got[:0], 7)) == 0
    units = N.Units([b"a", b"one"], 2, 7)
    line, others = units.line(docs)
    unit = lambda w: units.known.get(w) or 3 + zlib.crc32(w[-3:]) % 7
    assert line.tolist() == [0, *(u for x in each for u in [*map(unit, x), 0])]
    assert others.to_pylist() == [w for w in flat if w not in units.known]


@pytest.mark.parametrize("flush", [N._FLUSH, 2_000])
def test_word_counts_are_whole(spark, corpus, monkeypatch, flush):
    """Counted at a task's end, and many times before it."""
    monkeypatch.setattr(N, "_FLUSH", flush)
    monkeypatch.setattr(N, "_PIECE", 1_000)
    df, rows = corpus
    got = {bytes(r.word): r.n for r in N.word_counts(df, "text").collect()}
    assert got == Counter(w for _, t in rows for w in tokens(t))


def test_a_line_of_units_costs_less_than_a_split_and_a_look_up():
    """Two of the four passes over the texts make such lines, so their cost weighs: less than splitting into words and one look-up each."""
    import time

    rng = random.Random(6)
    frequent, others = [b"w%d" % i for i in range(2000)], [b"odd%d" % i for i in range(100_000)]
    sets = [[b" ".join(rng.choices(frequent, k=150) + rng.choices(others, k=50)) for _ in range(1000)] for _ in range(3)]
    known = {w: i for i, w in enumerate(frequent)}

    def cost(f):
        took = []
        for docs in sets:
            begin = time.process_time()
            f(docs)
            took.append(time.process_time() - begin)
        return min(took)

    plain = cost(lambda docs: [known.get(w, -1) for d in docs for w in d.lower().split()])
    assert cost(lambda docs: N.Units(frequent, 2000, 16).line(docs)) < plain


def test_classes_beat_single_words(spark, corpus):
    rows = N.class_bigram_scores(corpus[0], words=64, forms=16, classes=8).filter("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_model_is_a_distribution():
    """From any class, the moves' probabilities sum to 1, and so do those of its words with its share of unseen ones."""
    rng = np.random.default_rng(1)
    grid = rng.integers(1, 20, (3, 3)).astype(float)
    head = [(b"a", 9, 1), (b"b", 6, 1), (b"c", 4, 2)]
    m = N.Model(np.array([1, 2]), grid, np.array([5.0, 15.0, 4.0]), np.array([0.0, 0.0, 1.0]), head, 24, 4, 5, 20.0)
    assert np.allclose((10**m.move).sum(1), 1)
    for c in (1, 2):
        assert sum(10 ** m.head_log[m.row[w]] for w, _, k in head if k == c) + 10 ** m.unseen[c] == pytest.approx(1)


def small_bigrams(size=41, seed=2):
    rng = np.random.default_rng(seed)
    n = np.zeros((size, size))
    for i in range(1, size):
        for j in range(1, size):
            n[i, j] = rng.integers(5, 15) * ((i <= size // 2) == (j <= size // 2))
    return n


def test_exchange_finds_the_kinds():
    of = N.exchange(small_bigrams(), 3)
    assert len(set(of[1:21])) == 1 and len(set(of[21:])) == 1 and of[1] != of[40] and of[0] == 0


def test_gains_are_the_likelihoods_rise():
    rng = np.random.default_rng(0)
    n, of = rng.poisson(1, (30, 30)).astype(float), rng.integers(1, 5, 30)
    of[0] = 0

    def value(of):
        member = np.eye(5)[of]
        return N.likelihood(member.T @ n @ member)

    member = np.eye(5)[of]
    got = N.move_gains(member.T @ n @ member, n @ member, n.T @ member, np.diag(n).copy(), of, np.tile(np.arange(5), (30, 1)))
    for u in range(1, 30):
        for b in range(1, 5):
            there = of.copy()
            there[u] = b
            assert got[u, b] == pytest.approx(value(there) - value(of), abs=1e-6)


def test_rounds_settle_where_no_unit_gains_alone(spark):
    n = small_bigrams()
    bigrams = spark.createDataFrame([(i, j, int(n[i, j])) for i in range(41) for j in range(41) if n[i, j]], "a int, b int, n long")
    rounds = N.Rounds(bigrams, 4)
    rng = np.random.default_rng(5)
    begin = rng.integers(1, 4, 41)
    begin[0] = 0
    assert np.allclose(rounds.grid(begin), np.eye(4)[begin].T @ n @ np.eye(4)[begin])
    of, left = rounds.settle(begin, 0.0)
    assert left == 0 and not len(rounds.moves(of, rounds.grid(of))[0])
    assert N.likelihood(rounds.grid(of)) >= N.likelihood(rounds.grid(begin))
    assert not set(of[1:21]) & set(of[21:])
    placed = rounds.placed(np.where(np.arange(41) % 3 == 0, -1, of) * (np.arange(41) > 0), rounds.grid(of))
    assert not set(placed[1:21]) & set(placed[21:])


def test_every_training_word_has_a_class_of_its_contexts(spark):
    """Rare words go to the class that brute force finds, their counts and class bigrams being whole."""
    rng = random.Random(9)
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    rows = [(i, " ".join(x for _ in range(15) for x in (rng.choice(a), rng.choice(b))) + f" {rng.choice(a)} odd{i % 40}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.encode("text", "utf-8").alias("text"))
    names = [x.encode() for x in a + b]
    units = N.Units(names, 24, 4)
    of = np.array([0, *[1] * 12, *[2] * 12, 1, 2, 3, 3])
    grid = np.ones((4, 4))
    grid[1, 2] = grid[2, 1] = grid[2, 0] = 900
    got = N.rest_of(df, "text", spark.sparkContext.broadcast(units), of, grid).collect()
    words = {r.word: (int(r.n), r.cls) for r in got if r.word is not None}
    assert words == {N.signed(N.word_hash(f"odd{i}".encode())): (5, 2) for i in range(40)}
    assert spark.range(1).select(F.xxhash64(F.lit("odd1").cast("binary"))).first()[0] in words
    cells = Counter()
    for r in got:
        if r.word is None:
            cells[divmod(r.cls, 4)] += r.n
    assert {k: v for k, v in cells.items() if v} == {(1, 2): 200, (2, 0): 200}


def test_lm_edges(spark, edge, no_docs):
    df, rows = edge
    got = N.class_bigram_scores(df, words=8, forms=4, classes=4).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, len(tokens(t)) + 1) for i, t in rows)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert N.class_bigram_scores(no_docs, words=8, forms=4, classes=4).count() == 0


# --- operator 4


def base_rules(t):
    t = t or ""
    words = WORDS.findall(t.encode())
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(win)
    repeat = len({i + k for i, w in enumerate(win) if count[w] > 1 for k in range(3)})
    lines = [x for x in t.split("\n") if WORDS.search(x.encode())]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, len(words) < 50 or 100 * repeat > 50 * len(words))


def junk_corpus(spark):
    rng = random.Random(4)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows, labels = [], []
    for i in range(240):
        lines = [prose(rng, 30, vocab) + "." for _ in range(4)]
        if i % 3 == 0:
            lines = [" ".join(w + rng.choice(["***", "&&&", "$$$"]) for w in x.split()) for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(i % 3 != 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_line_field_keeps_content(spark):
    df, labels, rows = junk_corpus(spark)
    got = {r.doc_id: r for r in C.quality_rules(df, labels, train_docs=100).collect()}
    assert all(got[i].kept == (i % 3 != 0) for i, _ in rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(t)


def test_rules_edges(spark, edge, no_docs):
    df, rows = edge
    labels = spark.createDataFrame([(6, 1), (6, 0), (5, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = C.quality_rules(df, labels).collect()
    want = sorted(((i or -1), *base_rules(t)) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert C.quality_rules(no_docs, labels.limit(0)).count() == 0


def test_repeats_and_duplicate_lines(spark):
    t = "one two three four\none two three four\nlast line here\n\n\n"
    r = C.quality_rules(spark.createDataFrame([(1, t)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (r.n_dup_lines, r.n_repeat_words) == (1, 8) == base_rules(t)[3:5]


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    f = C.LineField()
    f.weights, f.step = rng.normal(size=f.weights.shape), rng.normal(size=(2, 2))
    docs = [rng.normal(size=(n, C.FEATURES)) for n in (1, 2, 5, 3, 0)]
    for d, got in zip(docs, f.decode(docs), strict=True):
        if not len(d):
            assert len(got) == 0
            continue
        e = np.array(d) @ f.weights
        score = lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(f.step[a, b] for a, b in zip(p, p[1:]))
        assert tuple(got) == max(product((0, 1), repeat=len(d)), key=score)


def test_gradient_against_differences():
    rng = np.random.default_rng(7)
    x = rng.normal(size=2 * C.FEATURES + 4)
    docs = [rng.normal(size=(n, C.FEATURES)) for n in (1, 3, 70, 2)]
    labels, share = [rng.integers(0, 2, len(d)) for d in docs], [0.5, 1.0, 0.2, 2.0]
    value = lambda p: C.LineField(p).gradient(docs, labels, share)
    got = value(x)
    for i in range(len(x)):
        d = np.zeros(len(x))
        d[i] = 1e-5
        assert got[1 + i] == pytest.approx((value(x + d)[0] - value(x - d)[0]) / 2e-5, abs=1e-4)


def test_climb_finds_the_maximum():
    a = np.diag([1.0, 10.0, 100.0])
    top = np.array([1.0, -2.0, 3.0])
    got = C.climb(lambda x: (-0.5 * (x - top) @ a @ (x - top), -a @ (x - top)), np.zeros(3), 100, near=1e-12)
    assert np.allclose(got, top, atol=1e-4)


def test_boilerplate_lines_are_found_in_good_texts(spark):
    """Notices set into good texts, most of them in labelled ones too: line F1, and documents with both kinds of lines."""
    rng = random.Random(8)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    notices = ["Subscribe to our letter for more", "All rights reserved by the owner of this page", "Sign in to read the comments"]
    rows, labels, truth = [], [], {}
    for i in range(300):
        lines = [prose(rng, rng.randint(12, 30), vocab).capitalize() + "." for _ in range(rng.randint(4, 8))]
        marks = [1] * len(lines)
        if i % 4 == 0:
            lines = [" ".join(w + rng.choice(["***", "&&&", "$$$"]) for w in x.split()) for x in lines]
            marks = [0] * len(lines)
        elif i % 4 == 1:
            at = rng.randint(0, len(lines))
            lines.insert(at, rng.choice(notices))
            marks.insert(at, 0)
        rows.append((i, "\n".join(lines)))
        truth[i] = marks
        if i < 150:
            labels.append((i, int(i % 4 != 0)))
    got = C.labelled_lines(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    pairs = Counter((a, b) for r in got for a, b in zip(truth[r.doc_id], r.content, strict=True))
    hit, over, under = pairs[0, 0], pairs[1, 0], pairs[0, 1]
    assert 2 * hit / (2 * hit + over + under) >= 0.95
    assert sum(0 < sum(r.content) < len(r.content) for r in got) >= 60


def test_lines_that_do_not_recur_are_found(spark):
    """Notices that recur label the fit; the field finds others, each of its own words and in one document only."""
    rng = random.Random(12)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    often = [" ".join(rng.choices(vocab, k=rng.randint(4, 8))).capitalize() for _ in range(4)]
    rows, labels, truth = [], [], {}
    for i in range(400):
        lines = [prose(rng, rng.choice([6, 14, 20, 30]), vocab).capitalize() + "." for _ in range(rng.randint(4, 8))]
        marks = [1] * len(lines)
        if i % 8 == 0:
            lines, marks = [" ".join(w + rng.choice(["***", "&&&"]) for w in x.split()) for x in lines], [0] * len(lines)
        elif i % 2:
            at = rng.randint(0, len(lines))
            lines.insert(at, rng.choice(often) if i < 200 else " ".join(rng.choices(vocab, k=rng.randint(4, 8))).capitalize())
            marks.insert(at, 0)
        rows.append((i, "\n".join(lines)))
        truth[i] = marks
        if i < 200:
            labels.append((i, int(i % 8 != 0)))
    got = C.labelled_lines(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).filter("doc_id >= 200").collect()
    pairs = Counter((a, b) for r in got if r.doc_id % 2 for a, b in zip(truth[r.doc_id], r.content, strict=True))
    hit, over, under = pairs[0, 0], pairs[1, 0], pairs[0, 1]
    assert hit + under == 100 and 2 * hit / (2 * hit + over + under) >= 0.8


# --- operator 5


def lang_corpus(spark):
    rng = random.Random(6)
    kinds = {"en": ["the", "with", "this", "thing", "would"], "de": ["der", "und", "nicht", "schön", "über"], "es": ["que", "niño", "para", "está", "corazón"]}
    rows = [(i, prose(rng, rng.randint(10, 80), kinds[k]), k) for i in range(300) for k in [["en", "de", "es"][i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_languages_of_held_out_documents(spark):
    df, rows = lang_corpus(spark)
    want = {i: k for i, _, k in rows}
    got = R.languages(df).collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i in want if fold(i, 3) == 1}
    assert all(r.lang_pred == want[r.doc_id] and 0 <= r.score <= 1 for r in got)


def test_place_distance_against_brute_force(spark):
    df, rows = lang_corpus(spark)
    found = [tuple(r) for r in R.language_profiles(df, "text", "lang", 40).collect()]

    def ngrams(t):
        b = b" " + t.encode().translate(R._LETTERS) + b" "
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                g = b[i : i + n]
                if (n == 1 and g != b" ") or (n == 2 and g != b"  ") or (n == 3 and g[1:2] != b" "):
                    out[int.from_bytes(g, "big") | (n - 1) << 24] += 1
        return out

    top = lambda c, k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k]]
    for lang in ("en", "de", "es"):
        total = Counter()
        for t in (t for _, t, k in rows if k == lang):
            total.update({g: n for g, n in ngrams(t).items()})
        # texts are joined by a blank, which makes no n-gram of its own
        assert [k for _, k, _ in sorted((p, k, n) for n, k, p in found if n == lang)] == top(total, 40)
    p = R.Profiles(found, 40)
    for _, t, _ in rows[:20]:
        mine = top(ngrams(t), 40)
        dist = {n: sum(abs(i - place[g]) if g in place else 40 for i, g in enumerate(mine)) for n in p.langs for place in [{k: q for m, k, q in found if m == n}]}
        best = min(sorted(dist), key=dist.get)
        assert p.predict(t.encode()) == (best, pytest.approx(1 - dist[best] / (len(mine) * 40)))


def test_language_edges(spark, edge, no_docs):
    df, rows = edge
    got = R.languages(df).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert R.languages(no_docs).count() == 0
    assert R.languages(spark.createDataFrame([(1, "1234 !!", "en"), (2, "日本", "en")], "doc_id long, text string, lang string")).filter("lang_pred = 'und'").filter("doc_id = 1").count() == 1
    assert {r.lang_pred for r in R.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- operator 6


def test_quality_of_held_out_documents(spark):
    df, labels, rows = junk_corpus(spark)
    got = Q.quality_scores(df, labels).collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i, _ in rows if fold(i, 5) == 0}
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in got) >= 0.97 * len(got)


def test_moments_and_density(spark):
    rng = np.random.default_rng(4)
    d = len(Q.NAMES)
    x, y = rng.normal(size=(60, d)), np.repeat([0, 1], 30)
    x[y == 1] += 1
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x)], "y int, x array<double>").repartition(3)
    m = Q.moments(df)
    for k in (0, 1):
        assert m[k][0] == 30 and np.allclose(m[k][1], x[y == k].sum(0)) and np.allclose(m[k][2], x[y == k].T @ x[y == k])
    pooled, ridge = 0.3, 0.1
    got = Q.Discriminant(m, pooled, ridge).scores(x)
    cov = {k: np.cov(x[y == k].T) for k in (0, 1)}
    within = sum(cov[k] * 29 for k in (0, 1)) / 58
    s = np.sqrt(np.diag(within))
    log = []
    for k in (0, 1):
        c = ((1 - pooled) * cov[k] + pooled * within) / np.outer(s, s)
        c = (1 - ridge) * c + ridge * np.trace(c) / d * np.eye(d)
        z = (x - x[y == k].mean(0)) / s
        log.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1] + np.log(0.5))
    assert np.allclose(got, 1 / (1 + np.exp(log[0] - log[1])))


def test_quality_edges(spark, edge, no_docs):
    df, rows = edge
    labels = spark.createDataFrame([(6, 1), (6, 0), (5, None), (None, 1), (8, 0), (7, 5)], "doc_id long, quality int")
    got = Q.quality_scores(df, labels).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) for r in got)
    assert {r.score for r in Q.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(no_docs, labels).count() == 0
