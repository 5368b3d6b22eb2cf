"""Concept graph of a chunked corpus, as node and edge tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored_small


@dataclass
class ConceptGraph:
    """nodes (node_id, type, name, page, ord), edges (src, dst, relation), chunk_concepts (chunk_id, chunk_ord, node_id, lex)."""

    nodes: DataFrame
    edges: DataFrame
    chunk_concepts: DataFrame


#: Names of an automaton; a longer lexicon is dealt into several, each a pass over the texts.
LEXICON_ROWS = 500_000
#: Rows of a batch that are handed to a worker at once, and pairs that it lays out at once.
_TEXTS, PAIRS = 512, 1 << 20
#: Rows of questions and nodes up to which a step along edges sends them to the edges.
FRONTIER = 100_000


def match_concepts(texts: DataFrame, lexicon: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``texts`` (of these the columns ``keep``) once for each concept (lex, concept) of the lexicon that the lower-cased text contains.

    One automaton of all names is built in each task and reads a text once, whatever the number of names: its time is that of the text
    and of what is found. Equal names of several concepts are found together; null and empty texts have no concepts, an empty name is
    in every other text.
    """
    names = lexicon.select("lex", "concept").filter("concept IS NOT NULL")
    blocks = max(1, -(-names.count() // LEXICON_ROWS))
    found = None
    for block in range(blocks):
        part = _read_once(texts, names.filter(F.pmod(F.xxhash64("concept"), F.lit(blocks)) == block).orderBy("lex", "concept").collect(), lexicon, text, texts.columns if keep is None else keep)
        found = part if found is None else found.unionByName(part)
    return found


def _read_once(texts: DataFrame, names: list, lexicon: DataFrame, text: str, keep: list[str]) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in names])  # at most LEXICON_ROWS names
    added = pa.schema([("lex", pa.int64()), ("concept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[int]] = {}
        for i, (_, name) in enumerate(sent.value):
            own.setdefault(name, []).append(i)
        automaton = ahocorasick.Automaton()
        for name, at in own.items():
            if name:
                automaton.add_word(name, at)
        automaton.make_automaton()
        lex, concept = (pa.array(c, t) for c, t in zip(zip(*sent.value, strict=True), added.types, strict=True)) if sent.value else (pa.array([], t) for t in added.types)
        for batch in (b.slice(i, _TEXTS) for b in batches for i in range(0, b.num_rows, _TEXTS)):
            rows: list[int] = []
            met: list[int] = []
            for row, low in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if low:
                    hits = {id(v): v for _, v in automaton.iter(low)} if len(automaton) else {}
                    at = sorted(i for v in [*hits.values(), own.get("", [])] for i in v)
                    met += at
                    rows += [row] * len(at)
            at, which = pa.array(rows, pa.int32()), pa.array(met, pa.int32())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[:-1]], lex.take(which), concept.take(which)], [*batch.schema.names[:-1], "lex", "concept"])

    kind = lexicon.schema["lex"].dataType
    rows = texts.select(*keep, F.lower(F.col(text)).alias("_low"))
    schema = T.StructType([*texts.select(*keep).schema.fields, T.StructField("lex", T.LongType()), T.StructField("concept", T.StringType())])
    return rows.mapInArrow(run, schema).withColumn("lex", F.col("lex").cast(kind))


def _section_key() -> object:
    return F.concat(F.lit("section::"), F.col("chapter"), F.lit("::"), F.col("section"))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists of (met, concept) in order the pairs of a concept and one that is met later, each once a batch."""
    for batch in batches:
        lists = batch.column(0)
        met, concept = (lists.flatten().field(i) for i in range(2))
        names = concept.dictionary_encode()
        code, place = names.indices.to_numpy().astype(np.int64), np.unique(np.stack([met.field(i).to_numpy(zero_copy_only=False) for i in range(2)], axis=1), axis=0, return_inverse=True)[1].ravel()
        size, width = pa.compute.list_value_length(lists).to_numpy(), len(names.dictionary)
        begin = np.cumsum(size) - size
        seen: list[np.ndarray] = []
        for m in np.unique(size[size > 1]).tolist():
            i, j = np.triu_indices(m, 1)
            at = begin[size == m]
            for s in range(0, len(at), step := max(1, PAIRS // len(i))):
                a, b = (at[s : s + step, None] + x for x in (i, j))
                seen.append(np.unique((code[a] * width + code[b])[place[a] != place[b]]))
        pairs = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(x)) for x in (pairs // max(1, width), pairs % max(1, width))], ["src", "dst"])


def build_graph(chunks: DataFrame, blocks: DataFrame, lexicon: DataFrame, chunked: bool = False) -> ConceptGraph:
    """CONTAINS chapter to section, DISCUSSES section to concept, DERIVES section to formula, CO_OCCURS between a section's concepts.

    The first chunk or block to name a node gives its attributes. CO_OCCURS points from the concept met first in the section (by chunk,
    then by place in the lexicon); a pair has one edge per direction, whatever the number of sections. ``chunked``: the blocks are those
    that the chunks were made of, so each of their sections has a chunk. What the chunks contain is found once and stored; there, and in
    shuffles, a section is known by the 128-bit digest of its name, which can be a line of text.
    """
    chapter = F.concat(F.lit("chapter::"), F.col("chapter"))
    section, has = _section_key(), F.col("section") != ""
    digest = F.when(has, F.unhex(F.md5(section))).alias("_key")
    first = lambda c: F.min_by(c, "chunk_ord")
    chapters = chunks.groupBy("chapter").agg(first("page_number").alias("page"), F.min("chunk_ord").alias("ord")).select(chapter.alias("node_id"), F.lit("chapter").alias("type"), F.col("chapter").alias("name"), "page", "ord")
    titled = chunks.filter(has)
    sections = titled.groupBy("chapter", "section").agg(first("page_number").alias("page"), F.min("chunk_ord").alias("ord")).select(section.alias("node_id"), F.lit("section").alias("type"), F.col("section").alias("name"), "page", "ord")
    found = stored_small(match_concepts(chunks.select("chunk_id", "chunk_ord", digest, "text"), lexicon, keep=["chunk_id", "chunk_ord", "_key"]))  # read by all that follows
    node = F.concat(F.lit("concept::"), "concept")
    concepts = found.groupBy("concept").agg(F.min("chunk_ord").alias("ord")).select(node.alias("node_id"), F.lit("concept").alias("type"), F.col("concept").alias("name"), F.lit(None).cast("int").alias("page"), "ord")
    body = F.trim("text")
    derived = blocks.filter((F.col("block_type") == "formula") & (F.length(body) >= 3)).withColumn("node_id", F.concat(F.lit("formula::"), F.substring(body, 1, 60))).withColumn("ord", F.col("doc_id") * 1_000_000 + F.col("block_idx"))
    formulas = derived.groupBy("node_id").agg(F.lit("formula").alias("type"), F.min_by(F.trim("text"), "ord").alias("name"), F.min_by("page_number", "ord").alias("page"), F.min("ord").alias("ord"))
    discussed = found.filter("_key IS NOT NULL").groupBy("_key", "concept").agg(F.min(F.struct("chunk_ord", "lex", "chunk_id")).alias("met"))
    # a section's concepts are at most the lexicon
    lists = discussed.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(F.struct("met.chunk_ord", "met.lex").alias("met"), "concept"))).alias("all")).select("all")
    pairs = lists.mapInArrow(_later, "src string, dst string").distinct().select(*[F.concat(F.lit("concept::"), c).alias(c) for c in ("src", "dst")])
    # names of sections come from the chunk that mentions a concept first
    told = discussed.groupBy(F.col("met.chunk_id").alias("chunk_id"), "_key").agg(F.collect_list(node).alias("dst"))
    named = titled.groupBy("chunk_id", digest).agg(F.first("chapter").alias("chapter"), F.first("section").alias("section"))
    edge = lambda df, src, dst, name: df.select(src.alias("src"), dst.alias("dst"), F.lit(name).alias("relation"))
    edges = edge(titled, chapter, section, "CONTAINS").distinct().unionByName(edge(told.join(named, ["chunk_id", "_key"]), section, F.explode("dst"), "DISCUSSES"))
    if not chunked:
        derived = derived.withColumn("_key", digest).join(titled.select(digest).distinct(), "_key", "left_semi")
    edges = edges.unionByName(edge(derived.filter(has), section, F.col("node_id"), "DERIVES").distinct()).unionByName(edge(pairs, F.col("src"), F.col("dst"), "CO_OCCURS"))
    nodes = chapters.unionByName(sections).unionByName(concepts).unionByName(formulas)
    return ConceptGraph(nodes, edges, found.select("chunk_id", "chunk_ord", node.alias("node_id"), "lex"))


def expand(start: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(query_id, node_id) of ``start`` with all nodes within so many edges, either way.

    Up to FRONTIER rows to go on from are numbered by node and sent to the edges: a node is shuffled with the numbers of its neighbours, not
    once for each question, and questions are put in their place where it arrives. More are joined.
    """
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")
    found = start.select("query_id", "node_id").distinct()
    for hop in range(hops):
        if hop:
            found = stored_small(found)
        front = found.limit(FRONTIER + 1).collect()
        if len(front) <= FRONTIER:
            number = {n: i for i, n in enumerate(sorted({r.node_id for r in front}))}
            spark, kind = start.sparkSession, start.schema["query_id"].dataType.simpleString()
            nodes = spark.createDataFrame([(i, n) for n, i in number.items()], "via int, node_id string")
            own: dict = {}
            for r in front:
                own.setdefault(r.query_id, []).append(number[r.node_id])
            asked = spark.createDataFrame([(i, q, at) for q, at in own.items() for i in at], f"via int, query_id {kind}, own array<int>")
            touched = both.join(F.broadcast(nodes), F.col("src") == F.col("node_id")).select(F.col("dst").alias("node_id"), "via").unionByName(nodes.select("node_id", "via"))
            met = touched.groupBy("node_id").agg(F.collect_set("via").alias("all")).select("node_id", "all", F.explode("all").alias("via"))
            # of the neighbours that a question has the first one puts it there, so nothing is said twice
            found = met.join(F.broadcast(asked), "via").filter(F.col("via") == F.array_min(F.array_intersect("all", "own"))).select("query_id", "node_id")
            continue
        found = found.unionByName(found.join(both, F.col("node_id") == F.col("src")).select("query_id", F.col("dst").alias("node_id"))).distinct()
    return found


def match_query_concepts(graph: ConceptGraph, queries: DataFrame) -> DataFrame:
    """(query_id, node_id) of the graph's concepts that a question contains."""
    known = graph.nodes.filter("type = 'concept'").select(F.lit(0).alias("lex"), F.col("name").alias("concept"))
    return match_concepts(queries, known, "question", ["query_id"]).select("query_id", F.concat(F.lit("concept::"), "concept").alias("node_id"))


def graph_search(graph: ConceptGraph, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, chunk_id, chunk_ord, score, matched): chunks of any concept within an edge of the question's, in corpus order."""
    # chunks hang on concepts only, so the way leads along edges between concepts
    near = expand(match_query_concepts(graph, queries), graph.edges.filter("relation = 'CO_OCCURS'"))
    # of each concept the first k chunks: a chunk among a question's first k is among the first k of each of its concepts
    by_concept = Window.partitionBy("node_id").orderBy("chunk_ord")
    first = graph.chunk_concepts.withColumn("_r", F.row_number().over(by_concept)).filter(F.col("_r") <= k).select("node_id", "chunk_id", "chunk_ord")
    w = Window.partitionBy("query_id").orderBy("chunk_ord")
    best = near.join(first, "node_id").select("query_id", "chunk_id", "chunk_ord").distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    why = best.join(graph.chunk_concepts.select("chunk_id", "node_id", "lex"), "chunk_id").join(near, ["query_id", "node_id"], "left_semi")
    names = F.array_sort(F.collect_set(F.struct("lex", F.substring("node_id", 10, 1000).alias("name"))))
    return why.groupBy("query_id", "rank", "chunk_id", "chunk_ord").agg(names.alias("m")).select("query_id", "rank", "chunk_id", "chunk_ord", F.lit(1.0).alias("score"), F.col("m.name").alias("matched"))


def related_concepts(graph: ConceptGraph, names: DataFrame) -> DataFrame:
    """(name, related): concepts that a concept's edges point to."""
    asked = names.select("name", F.concat(F.lit("concept::"), F.lower("name")).alias("src"))
    out = graph.nodes.filter("type = 'concept'").select(F.col("node_id").alias("dst"), F.col("name").alias("related"))
    return asked.join(graph.edges, "src").join(out, "dst").select("name", "related").distinct()


def concept_names(graph: ConceptGraph) -> DataFrame:
    return graph.nodes.filter("type = 'concept'").select("name").orderBy("name")


def graph_stats(graph: ConceptGraph) -> DataFrame:
    """(kind, name, n): nodes by type and edges by relation."""
    n = graph.nodes.groupBy("type").count().select(F.lit("node").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n"))
    return n.unionByName(graph.edges.groupBy("relation").count().select(F.lit("edge").alias("kind"), F.col("relation").alias("name"), F.col("count").alias("n")))
