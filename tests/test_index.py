"""The block-max index against scores of all chunks, growing indexes, the streaming chunk fold, and vector codes."""

import math
import random
from collections import Counter

from oracle import DATA
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import blocks as K
from sparkloom.operators import graph as G
from sparkloom.operators import lexical as L
from sparkloom.operators import quantised as V
from sparkloom.plans import text as plans

LARGER = "/root/testdata/sf0.01"
WORDS = [f"w{i:03d}" for i in range(400)]
WEIGHTS = [1 / (i + 1) for i in range(400)]


def frame(spark, chunks):
    return spark.createDataFrame([(f"c{o}", o, t) for o, t in chunks], "chunk_id string, chunk_ord long, text string").repartition(3)


def made(rng, n, start=0):
    return [(start + 7 * i, " ".join(rng.choices(WORDS, WEIGHTS, k=rng.randint(0, 50)))) for i in range(n)]


def scores(chunks, questions, k=5):
    """BM25 of all chunks for all questions."""
    docs = [(o, Counter(t.split())) for o, t in chunks]
    df = Counter(w for _, c in docs for w in c)
    n, average = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    out = []
    for q, text in questions:
        found = []
        for o, c in docs:
            s = sum(n * idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / average)) for w, n in Counter(text.split()).items() if w in c)
            found.append((-round(s, 6), o))
        out += [(q, r + 1, f"c{o}", -s) for r, (s, o) in enumerate(sorted(found)[:k]) if s < 0]
    return sorted(out)


def rows(found):
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in found.collect())


def test_search_equals_all_scores(spark, monkeypatch):
    rng = random.Random(1)
    chunks = made(rng, 600)
    chunks += [(10_000 + o, t) for o, t in chunks[:150]]  # equal scores
    questions = [(i, " ".join(rng.choices(WORDS, k=6) + rng.choices(WORDS[:20], k=4))) for i in range(25)] + [(99, "absent"), (100, "")]
    q = spark.createDataFrame(questions, "query_id long, question string")
    want = scores(chunks, questions)
    for size in (40, 8192):
        monkeypatch.setattr(L, "SEGMENT_CHUNKS", size)
        assert rows(L.bm25_search(L.bm25_index(frame(spark, chunks)), q)) == want
    monkeypatch.setattr(L, "QUERY_BLOCK", 7)
    assert rows(L.bm25_search(L.bm25_index(frame(spark, chunks)), q)) == want
    none = L.bm25_index(frame(spark, chunks).limit(0))
    assert L.bm25_search(none, q).count() == 0 == none.terms.count() and L.bm25_search(L.bm25_index(frame(spark, chunks)), q.limit(0)).count() == 0


def test_index_grows_and_shrinks(spark):
    rng = random.Random(2)
    a, b = made(rng, 300), made(rng, 200, 100_000)
    questions = [(i, " ".join(rng.choices(WORDS, k=5))) for i in range(12)]
    q = spark.createDataFrame(questions, "query_id long, question string")
    both = L.bm25_index(frame(spark, a)).with_segments(L.bm25_index(frame(spark, b)))
    assert rows(L.bm25_search(both, q)) == scores(a + b, questions)
    gone = [o for o, _ in (a + b)[::3]]
    less = both.without(spark.createDataFrame([(f"c{o}",) for o in gone[:80]], "chunk_id string")).without(spark.createDataFrame([(f"c{o}",) for o in gone[40:]] + [("no such",)], "chunk_id string"))
    left = [(o, t) for o, t in a + b if o not in set(gone)]
    assert rows(L.bm25_search(less, q)) == scores(left, questions)
    whole = L.bm25_index(frame(spark, left))
    for view in ("terms", "corpus", "postings"):
        get = lambda x: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in getattr(x, view).collect())  # noqa: B023, E731
        assert get(less) == get(whole)


def test_few_postings_are_read(spark):
    """Of the postings of the questions' terms, over the library's own chunks, less than a fifth is looked at."""
    with plans_together():
        index, asked = plans.index(spark, LARGER), plans.questions(spark, LARGER)
        dealt = next(L._question_blocks(asked.select("query_id", T.keyword_tokens(F.col("question")).alias("t"))))
        idf = {r.term: r.idf for r in index.terms.collect()}
        average = index.corpus.first().avgdl
        arrow = index.present().drop("segment", "terms", "dfs").toArrow().combine_chunks().to_batches()
    impact = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / average))
    held = read = 0
    for batch in arrow:
        for i in range(batch.num_rows):
            words = {t for ts in dealt.values() for t in ts}
            lists = L.Lists({n: batch.column(j)[i].values for j, n in enumerate(batch.schema.names)}, words, impact)
            for ts in dealt.values():
                held += sum(len(lists.lists[t][0]) for t in ts if t in lists.lists)
                lists.best({t: n * idf[t] for t, n in ts.items() if t in idf}, 5, 0.0)
            read += lists.read
    assert held > 200_000 and read < held / 5


def plans_together():
    from sparkloom.plans.testtables import together

    return together()


def test_long_document_is_folded_as_it_streams(spark):
    """A document over many batches, blocks in any order, gives the chunks of one fold over its sorted blocks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rng = random.Random(3)
        rows = [(d, i, i // 9, f"ch{i // 400}", f"s{i // 60}", "", " ".join(rng.choices(WORDS, k=rng.randint(1, 12))), rng.choice(["heading", "formula", "paragraph", "paragraph"])) for d, n in ((1, 2500), (2, 3), (3, 700)) for i in range(n)]
        want = []
        for d in (1, 2, 3):
            fold = K.Fold(d, 60, 10, False)
            for r in rows:
                if r[0] == d:
                    want += fold.feed(r[2:])
            want += fold.close()
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, block_idx int, page_number int, chapter string, section string, subsection string, text string, block_type string")
        got = K.section_chunks(df, 60, 10)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 200
        assert "ArrowEvalPython" not in got._jdf.queryExecution().toString() and "FlatMapGroups" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")




def test_codes_find_the_neighbours(spark, monkeypatch):
    """Nine in ten of the true neighbours are found by reading an eighth of the vectors' bytes; every row has a code; blocks of questions change nothing."""
    found = plans.QUERIES["knn_codes"](spark, "/root/testdata/sf0.1").collect()
    questions = {r.query_id for r in found}
    assert len(questions) == 100 and len(found) == 500
    assert sum(r.found for r in found) >= 0.9 * len(found) and all(r.read_share <= 0.125 for r in found)
    e, q = plans._vectors(spark, DATA)
    index = V.code_index(e)
    assert index.codes.count() == e.count() == index.n and index.codes.select(F.length("code")).distinct().first()[0] == 16
    want = sorted(map(tuple, V.knn_codes(index, q, keep_self=False).collect()))
    assert all(r[0] != r[2] for r in want)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "LISTED", 3)
    assert sorted(map(tuple, V.knn_codes(index, q, keep_self=False).collect())) == want


def test_codes_of_odd_tables(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 1.0]), (2, [0.0] * 5), (3, None), (4, [2.0, 0.0, 0.0, 0.0, 2.0]), (5, [0.0, 1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = V.code_index(df)
    got = V.knn_codes(index, df.withColumnRenamed("id", "query_id"), k=2).filter("query_id = 4").orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(1, 1.0), (4, 1.0)]
    assert V.knn_codes(V.code_index(df.limit(0)), df.withColumnRenamed("id", "query_id")).count() == 0 == V.knn_codes(index, df.limit(0).withColumnRenamed("id", "query_id")).count()


def test_names_are_found_whatever_their_number(spark, monkeypatch):
    """One automaton: names within names, equal names, empty and null texts, lexicons of any size; more names than rows cost no more passes."""
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choices(["Supply", "demand", "of", "oversupply", "É", "x.y"], k=12))) for i in range(60)] + [(60, ""), (61, None), (62, "no")]
    names = [(1, "supply"), (2, "demand of"), (3, "oversupply"), (4, "supply"), (5, "é"), (6, "."), (7, "y o"), (8, ""), (9, None)] + [(100 + i, f"absent{i}") for i in range(3000)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    lexicon = spark.createDataFrame(names, "lex int, concept string")
    want = sorted((i, n, c) for i, t in texts if t for n, c in names if c is not None and c in t.lower())
    found = lambda: sorted((r.id, r.lex, r.concept) for r in G.match_concepts(df, lexicon).collect())
    assert found() == want and len(want) > 150
    monkeypatch.setattr(G, "LEXICON_ROWS", 700)
    assert found() == want
    assert G.match_concepts(df, lexicon.limit(0)).count() == 0 == G.match_concepts(df.limit(0), lexicon).count()


def test_segments_are_read_one_by_one(spark):
    """Segments are small and a row group each; a search sums whole lists, equal to looking at blocks; counts of words need no index."""
    rng = random.Random(8)
    chunks = made(rng, 500)
    df = frame(spark, chunks).coalesce(1)
    assert L.SEGMENT_TOKENS <= 1_000_000
    index = L.bm25_index(df)
    assert sorted(map(tuple, L.document_counts(df).collect())) == sorted((r.term, r.df) for r in index.counts().collect())
    batch = index.present().select("chunk_ids", "chunk_ords", "dls", "lists", "gone").toArrow().combine_chunks().to_batches()[0]
    row = {n: batch.column(j)[0].values for j, n in enumerate(batch.schema.names)}
    impact = lambda tf, dl: tf / (tf + dl)
    asked = [{w: rng.random() for w in rng.sample(WORDS, 8)} for _ in range(20)] + [{"absent": 1.0}, {}]
    lists = L.Lists(row, {w for ts in asked for w in ts}, impact)
    for weights, (at, score) in zip(asked, L.summed(row, asked, [0.0] * len(asked), 5, impact), strict=True):
        places, best = lists.best(weights, 5, 0.0)
        assert sorted(zip(places.tolist(), best.round(9).tolist())) == sorted(zip(at.tolist(), score.round(9).tolist()))
    assert L.bm25_search(index, spark.createDataFrame([(1, " ".join(WORDS[:5]))], "query_id long, question string")).count() == 5
