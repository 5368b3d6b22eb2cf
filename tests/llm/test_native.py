"""Operators 8 and 9 and the pipeline: against brute force, and for what they must catch and leave alone."""

import random
import re
from collections import Counter, defaultdict

import pytest
from llm_helpers import prose
from pyspark.sql import functions as F

from sparkloom.llm import log_template as L
from sparkloom.llm import near_copies as N
from sparkloom.llm import template_leaks as T

WS = r"[\x20\x09-\x0D]+"


def words(line):
    return [w for w in re.split(WS, line) if w]


def mask(t):
    return re.sub(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>", t)


def brute_lines(rows, leading=3, min_words=3, similarity=0.7, min_docs=5, spread=0.5):
    """(n_lines, n_dropped, text) of each row by the definition, rows of equal id and text being one document."""
    docs = {(i, t) for i, t in rows}
    leaves = defaultdict(list)
    for doc in docs:
        lines = mask(doc[1] or "").split("\n")
        for at, line in enumerate(lines):
            w = words(line)
            if len(w) >= min_words:
                near = (lines[at - 1] if at else None, lines[at + 1] if at + 1 < len(lines) else None)
                leaves[len(w), tuple(w[:leading])].append((doc, line, near))
    gone = set()
    for hits in leaves.values():
        if len({d for d, _, _ in hits}) < min_docs:
            continue
        kinds = Counter(line for _, line, _ in hits)
        common = []
        for i in range(len(words(hits[0][1]))):
            n = Counter()
            for line, k in kinds.items():
                n[words(line)[i]] += k
            common.append(max(n, key=lambda w: (n[w], w.encode())))
        of = {line: None if sum(a == b for a, b in zip(words(line), common)) / len(common) >= similarity else line for line in kinds}
        by = defaultdict(lambda: (set(), set()))
        for d, line, near in hits:
            by[of[line]][0].add(d)
            by[of[line]][1].add(near)
        often = {k for k, (d, p) in by.items() if len(d) >= min_docs and len(p) >= min_docs and len(p) >= spread * len(d)}
        gone |= {line for line in kinds if of[line] in often}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        lines, masked = t.split("\n"), mask(t).split("\n")
        kept = [x for x, m in zip(lines, masked) if not (m in gone and len(words(m)) >= min_words)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def key(r):
    return str(tuple(r))


def line_corpus():
    rng = random.Random(12)
    rows = []
    for i in range(60):
        lines = [prose(rng, rng.randint(4, 12)) + "." for _ in range(rng.randint(2, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), f"Posted on day {i} by user{i} in the forum")
        if i % 4 == 0:
            lines.append("All rights reserved by the owner of this page")
        if i % 5 == 0:
            lines.append("All rights reserved by the keeper of that page")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[1][1]) for i in range(30)]  # copies of one document
    return rows


def test_line_dedup_against_brute_force(spark, edge):
    rows = [*line_corpus(), *edge[1]]
    out = L.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(key, out.select("doc_id", "n_lines", "n_dropped", "text").collect())) == sorted(map(key, brute_lines(rows)))


def test_line_dedup_catches_and_leaves(spark):
    rows = line_corpus()
    got = {r.doc_id: r for r in L.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("Posted on day" in r.text or "All rights" in r.text for r in got.values())
    clean = [i for i, _ in rows if i < 60 and i % 3 and i % 4 and i % 5]
    assert all(got[i].n_dropped == 0 and got[i].text == dict(rows)[i] for i in clean)
    # the lines of copied documents are not boilerplate
    assert all(got[100 + i].text == rows[1][1] for i in range(30))


def test_line_dedup_edges(spark, edge, no_docs):
    df, rows = edge
    out = L.drop_recurring_lines(df)
    assert set(out.columns) == set(df.columns) and out.count() == len(rows)
    assert {r.source for r in out.collect()} == {"s"}
    assert L.drop_recurring_lines(no_docs).count() == 0


ITEM = "A train leaves Paris with 120 people and travels 300 km in 4 hours before it stops near Lyon for lunch"


def leak_rows():
    rng = random.Random(13)
    around = lambda: prose(rng, 30)
    other = ITEM.replace("120", "75").replace("300", "450").replace("4 hours", "6 hours").replace("Paris", "Rome").replace("Lyon", "Pisa")
    broken = "A train leaves Paris with 7 people and travels 8 km in 9 hours before it stops near Lyon for lunch".replace("Lyon", "Paris")
    return [(1, f"{around()} {ITEM} {around()}"), (2, f"{around()} {other} {around()}"), (3, around()), (4, ITEM.upper()), (5, None), (6, ""), (7, " ".join(words(ITEM)[:5])), (8, f"{around()} {broken} {around()}"), (None, ITEM)]


def test_leaks_exact_and_with_other_values(spark):
    bench = spark.createDataFrame([(10, ITEM), (11, "Quite another question on the colour of the evening sky in winter"), (12, None), (13, ""), (None, "no id at all for this item of the benchmark")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in T.template_leaks(spark.createDataFrame(leak_rows(), "doc_id long, text string"), bench).collect()}
    assert got[1, 10].exact and not got[2, 10].exact
    assert got[1, 10].coverage > 0.9 and got[2, 10].coverage > 0.9
    # one value of the item answers to two of the document only if the item has it twice
    assert set(got) <= {(1, 10), (2, 10), (4, 10), (8, 10)}


def test_inconsistent_slots_are_no_leak(spark):
    item = "give 5 red balls and 5 blue balls and 5 green balls to each child in the room"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, item.replace("5", "9")), (2, item.replace("5 red", "7 red").replace("5 blue", "8 blue").replace("5 green", "6 green"))]
    got = [r.doc_id for r in T.template_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()]
    assert got == [1]


def test_whole_passages_against_brute_force(spark):
    """Every document that holds an item as it stands is found, and no other."""
    rng = random.Random(14)
    vocab = [f"{a}{b}{c}" for a in "brt" for b in "aeiou" for c in "lmnst"]
    items = [(i, prose(rng, rng.randint(15, 30), vocab)) for i in range(20)]
    docs = []
    for i in range(120):
        t = prose(rng, rng.randint(20, 90), vocab)
        if i % 6 == 0:
            t = f"{t} {items[i % 20][1]} {prose(rng, 20, vocab)}"
        docs.append((i, t))
    got = {(r.doc_id, r.item_id) for r in T.template_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if x in t}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_short_items_and_both_joins(spark, monkeypatch, limit):
    monkeypatch.setattr(T, "BROADCAST_WINDOWS", limit)
    bench = spark.createDataFrame([(1, "Only four words here"), (2, "too short"), (3, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before only four words here after"), (2, "too short"), (3, f"x {ITEM}")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in T.template_leaks(docs, bench).collect()} == {(1, 1), (3, 3)}


def test_placeholders_alone_are_no_leak(spark):
    items = spark.createDataFrame([(1, "9 10 11 12 13 14 15"), (2, "Add 9 10 11 12 13 14 15 to the sum now")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Values: 1 2 3 4 5 6 7 8 9 and more"), (2, "Please add 1 2 3 4 5 6 7 to the sum now or later")], "doc_id long, text string")
    for shifts in (False, True):
        assert {(r.doc_id, r.item_id) for r in T.template_leaks(docs, items, shifts=shifts).collect()} == {(2, 2)}


def test_leak_edges(spark, edge, no_docs):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert T.template_leaks(edge[0], bench).count() == 0
    assert T.template_leaks(no_docs, bench).count() == 0
    assert T.template_leaks(edge[0], bench.limit(0)).count() == 0
    assert T.drop_leaked(edge[0], T.template_leaks(edge[0], bench)).count() == len(edge[1])


def test_native_plans_run_no_python(spark):
    docs = spark.createDataFrame(line_corpus(), "doc_id long, text string").select("*")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for df in (L.drop_recurring_lines(docs), T.template_leaks(docs, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["op8_line_dedup", "op9_decontamination"])
def test_equals_sql(spark, name):
    from oracle import DATA, connect, same

    from sparkloom.llm.queries import ORACLE_SQL, QUERIES

    same(QUERIES[name](spark, DATA), connect(DATA), ORACLE_SQL[name])


# --- the pipeline


def test_pipeline(spark, tmp_path):
    """Stage by stage: every stage works on what is left, and its decisions take effect."""
    import corpus_pipeline as P

    rng = random.Random(15)
    english = ["the", "river", "stone", "with", "under", "quiet", "hills", "walking", "seven", "paper", "green", "light"]
    german = ["der", "fluss", "stein", "mit", "unter", "leise", "hügel", "gehen", "sieben", "papier", "grün", "licht"]
    rows = []
    for i in range(80):
        lines = [prose(rng, 25, (english, german)[i % 2]) for _ in range(4)]
        if i % 4 == 0:
            lines.insert(rng.randrange(4), f"Copyright notice number {i} of the big publisher")
        if i in (13, 43, 55):  # too few for a template of lines
            lines.append(ITEM)
        rows.append((i, "\n".join(lines), ("en", "de")[i % 2]))
    rows += [(200, rows[1][1], "de"), (201, rows[1][1], "de"), (202, "12345 67 !!!", "en"), (203, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        if name != "bpe_codec":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    ids = set(range(80)) | {200, 201}
    assert set(kept["language_id"]) == ids
    assert set(kept["line_dedup"]) == ids
    assert not any("Copyright" in r.text or r.n_chars != len(r.text) for r in kept["line_dedup"].values())
    assert set(kept["near_dedup"]) == ids - {200, 201}
    assert set(kept["decontamination"]) == set(range(80)) - {13, 43, 55}
    assert set(kept["bpe_codec"]) == set(kept["decontamination"])
    assert P.run(spark, d).count() == len(kept["bpe_codec"])


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as P

    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert P.run(spark, d).count() == 0


def test_line_dedup_stage_drops_notices_of_several_lines(spark):
    """A notice of three lines goes whole, at the end of texts too, however often its texts are copied; lines of near copies stay."""
    import corpus_pipeline as P

    rng = random.Random(16)
    notice = ["This text is kept by the town archive", "Please ask before you print it", "Write to the keeper at the gate"]
    vocab = [f"{a}{b}{c}" for a in "brt" for b in "aeiou" for c in "lmnst"]
    own = [[prose(rng, rng.randint(8, 14), vocab) for _ in range(5)] for _ in range(12)]
    rows = [(i, "\n".join([*lines, "", notice[0], "", *notice[1:]])) for i, lines in enumerate(own)]
    rows += [(100 + i, rows[i % 12][1]) for i in range(48)]
    base = [prose(rng, 10, vocab) for _ in range(8)]
    for i in range(20):  # near copies: a changed word in the middle line, by turns with another number of words
        words_of = base[3].split()
        words_of[5 + i % 4] = f"word{'abcdefghijklmnopqrst'[i]}"
        rows.append((200 + i, "\n".join([*base[:3], " ".join(words_of), *base[4:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.line_dedup(spark, docs, "").collect()}
    assert not any(line in text for text in got.values() for line in notice)
    assert all(x in got[i] for i in range(12) for x in own[i])
    # beside the changed line the first rule, by single lines, drops lines
    assert all(x in got[i] for i in range(200, 220) for x in [*base[:2], *base[5:]])


def test_near_dedup_stage_links_similar_texts(spark):
    """Texts of five-word similarity 0.8 are linked, others not, and equal ids with different texts both stay."""
    import corpus_pipeline as P

    rng = random.Random(17)
    vocab = [f"{a}{b}{c}" for a in "brt" for b in "aeiou" for c in "lmnst"]
    rows = []
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(100)]
        near = list(w)
        near[50] = "changed"  # 5 of 96 shingles
        far = [*w[:60], *(rng.choice(vocab) for _ in range(40))]
        rows += [(i, " ".join(w)), (100 + i, " ".join(near)), (200 + i, " ".join(far))]
    rows += [(7, "quite another text of the same id"), (None, rows[0][1]), (300, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.near_dedup(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in rows if i is None or i < 100 or 200 <= i < 300)


def _form_letters(rng, n, words, own):
    """``n`` texts of ``words`` words that share a form but for a run of ``own`` words, and a near copy of every 50th of them."""
    form = [f"w{rng.randrange(10**6)}" for _ in range(words - own)]
    texts = [[*form[: len(form) // 2], *(f"w{rng.randrange(10**6)}" for _ in range(own)), *form[len(form) // 2 :]] for _ in range(n)]
    for t in texts[::50]:
        near = list(t)
        near[-3] = f"w{rng.randrange(10**6)}"
        texts.append(near)
    return [" ".join(t) for t in texts]


def test_crowded_bands_give_few_pairs(spark, monkeypatch):
    """5000 form letters that share two thirds of their words: pairs grow with the texts, near copies among them are all found."""
    rng = random.Random(31)
    seen = []
    across = N.across_components
    monkeypatch.setattr(N, "across_components", lambda *a: seen.append(across(*a)) or seen[-1])
    texts = _form_letters(rng, 5000, 150, 50)
    docs = spark.createDataFrame(list(enumerate(texts)), "th long, text string")
    got = {r.th: r.root for r in N.near_copies(docs).collect()}
    assert got == {i: 50 * j for j in range(100) for i in (50 * j, 5000 + j)}
    assert seen[0].count() < 5100


def test_crowded_bands_against_all_pairs(spark, monkeypatch):
    """Crowds of one and more components, with any size of crowd the same links as all pairs."""
    rng = random.Random(32)
    texts = [*_form_letters(rng, 120, 100, 30), *_form_letters(rng, 60, 60, 14), *_form_letters(rng, 30, 90, 6)]
    sets = [set(N.shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    docs = spark.createDataFrame(list(enumerate(texts)), "th long, text string")
    for crowd in (2, 16, 10**9):
        monkeypatch.setattr(N, "CROWD", crowd)
        assert {r.th: r.root for r in N.near_copies(docs).collect()} == want


def test_copies_with_words_of_their_own_give_few_pairs(spark, monkeypatch):
    """600 copies of one text, each with four changed words (similarity about 0.5), and near copies of some: pairs verified grow with the texts."""
    rng = random.Random(33)
    seen = []
    similar = N._similar
    monkeypatch.setattr(N, "_similar", lambda pairs, sets: seen.append(pairs.count()) or similar(pairs, sets))
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(100)]
    texts = []
    for _ in range(600):
        t = list(base)
        for i in rng.sample(range(5, 95), 4):
            t[i] = word()
        texts.append(t)
    texts += [[*t[:-1], word()] for t in texts[::50]]
    texts = [" ".join(t) for t in texts]
    sets = [set(N.shingles(t.encode()).tolist()) for t in texts]
    links = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))
    for i, j in links:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    got = {r.th: r.root for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "th long, text string")).collect()}
    assert got == {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert len(got) >= 24 and sum(seen) < 12 * len(texts)


def test_short_items_with_marks_and_names(spark):
    """Lone marks are no words, and an item's first word may stand within a sentence."""
    bench = spark.createDataFrame([(1, "What is 3 + 4 ?"), (2, "Only four words here"), (3, "Seldom do grey herons sleep")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before What is 3 + 4 ? after"), (2, "before Only four words here after"), (3, "then Seldom do grey herons sleep"), (4, "only four other words here")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.exact) for r in T.template_leaks(docs, bench).collect()} == {(1, 1, True), (2, 2, True), (3, 3, True)}


def test_decontamination_stage_finds_values_of_other_lengths(spark, tmp_path):
    import corpus_pipeline as P

    item = "the slow train from Boston left with 4 crates of apples for Denver and came back with 6 boxes of tea after a week in Dallas where it rained"
    other = item.replace("Boston", "New York").replace("4 crates", "3 1/2 crates").replace("Denver", "Salt Lake City").replace("6 boxes", "7 1/2 boxes").replace("Dallas", "San Jose")
    put = " ".join(w + (" indeed" if i % 8 == 7 else "") for i, w in enumerate(item.split()))
    odd = item + ". Thus from Boston left with 9 crates of apples for Denver"
    rng = random.Random(18)
    rows = [(1, item), (2, other), (3, put), (4, odd.replace("4", "5", 1)), (5, prose(rng, 60))]
    spark.createDataFrame([(1, item), (2, "Mr Jones Miss Smith")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, f"{prose(rng, 20)} {t} {prose(rng, 20)}") for i, t in rows], "doc_id long, text string")
    assert [r.doc_id for r in P.decontamination(spark, docs, str(tmp_path)).collect()] == [5]
