import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import blocks as K
from sparkloom.operators import fusion as U
from sparkloom.operators import graph as G
from sparkloom.operators import lexical as L
from sparkloom.operators import vectors as V
from sparkloom.sources import tables as S


def lines(spark, texts):
    return spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "doc_id long, page int, line_no int, text string")


def test_headings_carry_and_reset(spark):
    got = K.parse_blocks(lines(spark, ["abc", "Chapter 1", "1.1 A", "xxx", "1.1.1 B", "yyy", "1.2 C", "zzz", "CHAPTER 2", "www", "ab"])).orderBy("block_idx").collect()
    where = {r.text: (r.chapter, r.section, r.subsection) for r in got}
    assert where["abc"] == ("Unknown Chapter", "", "")
    assert where["xxx"] == ("Chapter 1", "1.1 A", "") and where["yyy"] == ("Chapter 1", "1.1 A", "1.1.1 B")
    assert where["zzz"] == ("Chapter 1", "1.2 C", "") and where["www"] == ("CHAPTER 2", "", "")
    assert "ab" not in where


def test_table_lines_go(spark):
    tables = spark.createDataFrame([(1, 1, 1, "cell one | cell two")], "doc_id long, page int, table_no int, text string")
    got = [(r.text, r.block_type) for r in K.parse_blocks(lines(spark, ["cell one", "other text"]), tables).orderBy("block_idx").collect()]
    assert got == [("cell one | cell two", "table"), ("other text", "paragraph")]


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, 1, "C", sec, "", t, kind) for i, (sec, t, kind) in enumerate(rows, 1)], "doc_id long, block_idx int, page_number int, chapter string, section string, subsection string, text string, block_type string")


CHUNKS = [("s1", "h1", "heading"), ("s1", "a b c d e", "paragraph"), ("s2", "h2", "heading"), ("s2", "f g", "paragraph"), ("s2", "x = y z w v u t", "formula"), ("s2", "tail", "paragraph"), ("s3", "h3", "heading")]


def test_chunk_fold(spark):
    got = K.section_chunks(blocks(spark, CHUNKS), 10, 3).orderBy("chunk_ord").collect()
    assert [(r.section, r.text) for r in got] == [("s1", "h1 a b c d e"), ("s2", "c d e h2 f g x = y z w v u t tail"), ("s3", "u t tail h3")]


def test_chunk_fold_compat(spark):
    got = K.section_chunks(blocks(spark, CHUNKS), 10, 3, compat=True).orderBy("chunk_ord").collect()
    assert [(r.section, r.text) for r in got] == [("s1", "h1 a b c d e"), ("s1", "c d e h2 f g x = y z w v u t tail"), ("s2", "u t tail"), ("s2", "u t tail h3")]


def chunks(spark, texts):
    return spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], "chunk_id string, chunk_ord long, text string")


def test_bm25(spark):
    index = L.bm25_index(chunks(spark, ["law of motion", "law law energy", "energy field", "charge field unit"]))
    q = spark.createDataFrame([(1, "law law"), (2, "the is"), (3, "absent"), (4, "energy")], "query_id long, question string")
    got = {(r.query_id, r.rank): r.chunk_id for r in L.bm25_search(index, q).collect()}
    twice = {r.chunk_id: r.score for r in L.bm25_search(index, q).filter("query_id = 1").collect()}
    once = {r.chunk_id: r.score for r in L.bm25_search(index, spark.createDataFrame([(1, "law")], "query_id long, question string")).collect()}
    assert {k[0] for k in got} <= {1, 4}
    assert all(twice[c] == pytest.approx(2 * once[c], abs=1e-5) for c in once)


def test_tokens_fall_back(spark):
    df = spark.createDataFrame([("The is",), ("A-b Field, naïve",), ("",)], "t string")
    assert [r[0] for r in df.select(T.keyword_tokens(F.col("t"))).collect()] == [["the", "is"], ["field", "naïve"], []]


def test_rrf_sums_and_ties(spark):
    rows = [(1, "a", 0, 1, "x"), (1, "a", 0, 2, "y"), (1, "b", 1, 1, "z"), (1, "b", 1, 2, "x"), (1, "c", 2, 2, "w")]
    got = U.rrf(spark.createDataFrame(rows, "query_id long, source string, source_order int, rank int, chunk_id string")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["x", "z", "y", "w"]
    assert got[0].rrf == pytest.approx(1 / 61 + 1 / 62) and got[0].source == "a"


def test_graph_edges(spark):
    c = spark.createDataFrame([("c1", 1, "C", "s1", 1, "beta first"), ("c2", 2, "C", "s1", 1, "alpha and gamma"), ("c3", 3, "C", "s2", 2, "gamma alpha")], "chunk_id string, chunk_ord long, chapter string, section string, page_number int, text string")
    lex = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "lex int, concept string")
    b = spark.createDataFrame([(1, 1, 1, "C", "s1", "", "E = mc", "formula")], "doc_id long, block_idx int, page_number int, chapter string, section string, subsection string, text string, block_type string")
    g = G.build_graph(c, b, lex)
    pairs = {(r.src[9:], r.dst[9:]) for r in g.edges.filter("relation = 'CO_OCCURS'").collect()}
    assert pairs == {("beta", "alpha"), ("beta", "gamma"), ("alpha", "gamma")}
    assert {(r.relation, r.n) for r in g.edges.groupBy("relation").count().withColumnRenamed("count", "n").collect()} == {("CONTAINS", 2), ("DISCUSSES", 5), ("DERIVES", 1), ("CO_OCCURS", 3)}
    q = spark.createDataFrame([(1, "what is Beta"), (2, "nothing")], "query_id long, question string")
    assert [(r.query_id, r.chunk_id) for r in G.graph_search(g, q).orderBy("rank").collect()] == [(1, "c1"), (1, "c2"), (1, "c3")]


def test_recall_and_faithfulness(spark):
    df = spark.createDataFrame([("Alpha beta gamma delta", ["ALPHA", "zeta"], "The alpha beta gamma is long enough. Nothing of this sentence is there. Short.")], "t string, k array<string>, a string")
    r = df.select(T.keyword_recall(F.col("t"), F.col("k")).alias("r"), T.faithfulness(F.col("a"), F.col("t")).alias("f")).first()
    assert r.r == 0.5 and r.f == 0.5


def test_knn_and_cells_agree(spark):
    import random

    random.seed(5)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    c = spark.createDataFrame(rows, "id long, vector array<double>")
    q = c.filter("id < 7").withColumnRenamed("id", "query_id")
    exact = sorted(map(tuple, V.knn_exact(c, q).select("query_id", "rank", "id").collect()))
    cells, centroids = V.ivf_build(c, nlist=6)
    assert sorted(map(tuple, V.knn_ivf(cells, centroids, q, nprobe=6, block=20).select("query_id", "rank", "id").collect())) == exact
    some = {(a, b) for a, _, b in map(tuple, V.knn_ivf(cells, centroids, q, nprobe=3).select("query_id", "rank", "id").collect())}
    assert len(some & {(a, b) for a, _, b in exact}) >= 0.5 * len(exact)
    assert all(a == b for a, r, b in exact if r == 1)


def test_rerank_hook(spark):
    rows = [(1, f"c{i}", "q", "t" * i, i) for i in range(1, 9)]
    fused = spark.createDataFrame(rows, "query_id long, chunk_id string, question string, text string, rank int")
    best = U.rerank(fused, lambda: lambda q, t: [float(len(x)) for x in t]).orderBy("rank").collect()
    assert [r.chunk_id for r in best] == ["c8", "c7", "c6", "c5", "c4", "c3"]
    assert [r.chunk_id for r in U.rerank(fused).orderBy("rank").collect()] == [f"c{i}" for i in range(1, 7)]


def test_blocks_and_index_round_trip(spark, tmp_path):
    b = blocks(spark, CHUNKS)
    S.write_json(b, str(tmp_path / "blocks"))
    assert sorted(map(tuple, S.read_blocks(spark, str(tmp_path / "blocks")).collect())) == sorted(map(tuple, b.collect()))
    index = L.bm25_index(chunks(spark, ["law of motion", "energy field"]))
    S.save_index({"postings": index.postings, "terms": index.terms}, str(tmp_path / "index"))
    back = S.load_index(spark, str(tmp_path / "index"), ["postings", "terms"])
    assert back["postings"].drop("bucket").count() == index.postings.count() and back["terms"].count() == index.terms.count()


def test_recall_of_the_index(spark):
    """Every row is in a cell; half of the cells find at least nine in ten of the true neighbours."""
    from oracle import DATA

    from sparkloom.plans.text import QUERIES

    pairs = lambda name: {(r.query_id, r.id) for r in QUERIES[name](spark, DATA).collect()}
    exact = pairs("knn_exact")
    assert len(pairs("knn_ivf") & exact) >= 0.9 * len(exact)


def test_many_questions_meet_the_corpus_in_blocks(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.filter("id % 3 = 0").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, V.knn_exact(e, q, keep_self=False).select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 20)
    assert sorted(map(tuple, V.knn_exact(e, q, keep_self=False, block=30).select("query_id", "rank", "id").collect())) == want
    assert V.knn_exact(e.limit(0), q, block=30).count() == 0


def test_long_lexicons_are_joined(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Supply and demand of labour"), (2, "la"), (3, None), (4, "oversupply")], "id long, text string")
    names = spark.createDataFrame([(1, "supply"), (2, "demand of"), (3, "and"), (4, "labours")], "lex long, concept string")
    found = lambda: sorted((r.id, r.concept) for r in G.match_concepts(texts, names).collect())
    want = found()
    assert want == [(1, "and"), (1, "demand of"), (1, "supply"), (4, "supply")]
    monkeypatch.setattr(G, "LEXICON_ROWS", 2)
    assert found() == want


def test_symbols_as_a_class(spark):
    """Greek letters and signs by one class are those of the fixed pattern, for every code point."""
    points = spark.range(1, 0x110000).filter("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert points.filter(F.regexp_like("c", F.lit(T.FORMULA_PATTERNS[2])) != F.regexp_like("c", F.lit(T._SYMBOLS))).count() == 0
    assert points.filter(F.regexp_like("c", F.lit(T._SYMBOLS))).count() == 18


def test_lines_meet_tables_without_a_join(spark):
    """One shuffle for blocks and for the chunks made of them; tables of other pages and null keys drop nothing."""
    rows = [(1, 1, 0, "cell one"), (1, 2, 1, "cell one"), (None, 1, 2, "cell one"), (1, None, 3, "cell one"), (1, 1, 4, "Chapter 1"), (1, 1, 5, "cell two")]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string")
    tables = spark.createDataFrame([(1, 1, 1, " Chapter 1 | cell one "), (1, 1, 2, "cell two and more"), (None, 1, 1, "cell one"), (1, None, 1, "cell one")], "doc_id long, page int, table_no int, text string")
    got = K.parse_blocks(df, tables)
    assert sorted((str(r.doc_id), str(r.page_number), r.text) for r in got.filter("block_type <> 'table'").collect()) == [("1", "1", "Chapter 1"), ("1", "2", "cell one"), ("1", "None", "cell one"), ("None", "1", "cell one")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = K.section_chunks(got)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_tokens_of_odd_texts(spark):
    """Words are the runs that are left when all but letters, digits, marks and joiners are blanks."""
    texts = ["", " ", "a", "The a", "x_y-z.9", "É́t naïve‍x   ‿q", "٣٤ Ⅷ ①", None, "İstanbul ß"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.filter(F.split(F.regexp_replace(F.lower("t"), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda x: x != "")
    some = F.filter(every, lambda x: (F.length(x) > 1) & ~x.isin(T.STOPWORDS))
    assert all(a == b for a, b in df.select(T.keyword_tokens(F.col("t")), F.when(F.size(some) > 0, some).otherwise(every)).collect())


def test_few_wanted_texts_move(spark, tmp_path):
    """Few wanted chunks are sent to the texts, so no text is shuffled."""
    c = spark.createDataFrame([(f"c{i}", i, "t" * 50) for i in range(100)], "chunk_id string, chunk_ord long, text string")
    c.write.parquet(str(tmp_path / "chunks"))
    ranked = spark.createDataFrame([(1, "c7", 1), (1, "c9", 2), (2, "none", 1)], "query_id long, chunk_id string, rank int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = U.hydrate(ranked, spark.read.parquet(str(tmp_path / "chunks")))
        assert sorted((r.query_id, r.chunk_id, len(r.text)) for r in got.collect()) == [(1, "c7", 50), (1, "c9", 50)]
        assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_step_along_edges_sends_the_frontier(spark, monkeypatch):
    """Nodes are shuffled once with their neighbours' numbers, whatever the number of questions; the result is that of joins."""
    import random

    rng = random.Random(4)
    edges = spark.createDataFrame([(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)], "src string, dst string")
    start = spark.createDataFrame([(q, f"n{rng.randrange(45)}") for q in range(6) for _ in range(2)] * 2, "query_id long, node_id string")
    got = {h: sorted(map(tuple, G.expand(start, edges, h).collect())) for h in (0, 1, 2)}
    monkeypatch.setattr(G, "FRONTIER", 1)
    assert {h: sorted(map(tuple, G.expand(start, edges, h).collect())) for h in (0, 1, 2)} == got and len(got[2]) > len(got[1]) > len(got[0])
    monkeypatch.setattr(G, "FRONTIER", 100)
    plan = G.expand(start, edges, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "collect_set" in plan


def test_graph_is_made_of_digests(spark):
    """What chunks contain is stored without texts or sections' names; equal orders give no pair; sections of blocks without chunks derive nothing."""
    c = spark.createDataFrame([("c1", 1, "C", "s1", 1, "beta alpha"), ("c2", 2, "C", "s1", 1, "gamma"), ("c3", 3, "C", "", 1, "alpha beta"), ("c4", 4, "D", "s1", 1, "gamma beta")], "chunk_id string, chunk_ord long, chapter string, section string, page_number int, text string")
    lex = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "gamma")], "lex int, concept string")
    b = spark.createDataFrame([(1, 1, 1, "C", "s1", "", "E = mc", "formula"), (1, 2, 1, "C", "gone", "", "F = ma", "formula")], "doc_id long, block_idx int, page_number int, chapter string, section string, subsection string, text string, block_type string")
    g = G.build_graph(c, b, lex)
    made = lambda r: sorted((x.src.split("::", 1)[1], x.dst.split("::", 1)[1]) for x in g.edges.filter(F.col("relation") == r).collect())
    assert made("CO_OCCURS") == [("alpha", "gamma"), ("beta", "gamma")]
    assert made("DISCUSSES") == [("C::s1", "alpha"), ("C::s1", "beta"), ("C::s1", "gamma"), ("D::s1", "beta"), ("D::s1", "gamma")]
    assert made("DERIVES") == [("C::s1", "E = mc")] and made("CONTAINS") == [("C", "C::s1"), ("D", "D::s1")]
    plan = g.edges.filter("relation = 'CO_OCCURS'")._jdf.queryExecution().optimizedPlan().toString()
    assert "section" not in plan and "text" not in plan
    assert G.match_concepts(c, lex, keep=["chunk_id"]).columns == ["chunk_id", "lex", "concept"]


def test_questions_of_a_cell_are_dealt_too(spark, monkeypatch):
    """A meeting of a cell holds a bounded number of vectors and of questions; all cells need no meeting, all codes no list of candidates."""
    from sparkloom.operators import quantised as Q

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).limit(400)
    e = e.unionByName(e.filter("id % 4 = 0").withColumn("id", F.col("id") + 100_000)).cache()  # equal scores
    q = e.filter("id % 9 = 0").withColumnRenamed("id", "query_id")
    cells, centroids = V.ivf_build(e, nlist=6)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id", F.round("score", 6)).collect()))
    some, exact, index = rows(V.knn_ivf(cells, centroids, q, nprobe=3)), rows(V.knn_exact(e, q)), Q.code_index(e)
    monkeypatch.setattr(V, "QUERY_BLOCK", 10)
    monkeypatch.setattr(V, "SCORES", 64)
    monkeypatch.setattr(V, "VECTORS", 16)
    assert rows(V.knn_ivf(cells, centroids, q, nprobe=3, block=30)) == some
    assert rows(V.knn_exact(e, q)) == rows(V.knn_ivf(cells, centroids, q, nprobe=6)) == exact
    all_of_them = Q.knn_codes(index, q, rescored=index.n)
    assert [r[:3] for r in rows(all_of_them)] == [r[:3] for r in exact]
    plan = all_of_them._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroups" not in V.knn_ivf(cells, centroids, q, nprobe=6)._jdf.queryExecution().optimizedPlan().toString()
