"""From lines of text to structured blocks and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation, heading_kind, is_formula, word_count

BLOCK_COLS = ["doc_id", "block_idx", "page_number", "chapter", "section", "subsection", "text", "block_type"]
CHUNK_SCHEMA = "chunk_id string, doc_id long, chunk_ord long, text string, page_number int, page_end int, chapter string, section string, subsection string, block_types array<string>, token_count int"


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text) of every line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("line_no"), "text")


def drop_table_lines(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines whose first 50 characters stand in the first 200 of a table of their page are left out."""
    t = tables.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.substring(F.trim("text"), 1, 200).alias("_t"))
    same = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & F.contains("_t", F.substring("text", 1, 50))
    return lines.join(t, same, "left_anti")


def parse_blocks(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Blocks of (doc_id, page, line_no, text) lines, headings carried down, and of (doc_id, page, table_no, text) tables.

    Lines of under three characters go. A page's tables stand before its lines, under the headings of the page before.
    """
    rows = lines.select("doc_id", "page", "line_no", F.trim("text").alias("text")).filter(F.length("text") >= 3).withColumn("kind", heading_kind(F.col("text"))).withColumn("formula", F.when(F.col("kind").isNull(), is_formula(F.col("text"))))
    if tables is not None:  # lines meet their page's tables where the document's rows are gathered for the headings, so all is shuffled once
        own = tables.select("doc_id", "page", (F.col("table_no") - 1_000_000).alias("line_no"), "text", F.lit("table").alias("kind"), F.lit(False).alias("formula"))
        page = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cells = F.collect_list(F.when(F.col("kind") == "table", F.substring(F.trim("text"), 1, 200))).over(page)
        told = F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.exists("_cells", lambda t: F.contains(t, F.substring("text", 1, 50)))
        rows = rows.unionByName(own).repartition("doc_id").withColumn("_cells", cells).filter(F.col("kind").isNotNull() | ~told).drop("_cells")
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    k, t = F.col("kind"), F.col("text")
    carry = lambda marks: F.last(marks, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    chapter = F.coalesce(carry(F.when(k == "chapter", t)), F.lit("Unknown Chapter"))
    section = F.coalesce(carry(F.when(k == "chapter", "").when(k == "section", t)), F.lit(""))
    subsection = F.coalesce(carry(F.when(k.isin("chapter", "section"), "").when(k == "subsection", t)), F.lit(""))
    kind = F.when(k == "table", "table").when(k.isNotNull(), "heading").when(F.col("formula"), "formula").otherwise("paragraph")
    return rows.select("doc_id", F.row_number().over(w).alias("block_idx"), F.col("page").alias("page_number"), chapter.alias("chapter"), section.alias("section"), subsection.alias("subsection"), "text", kind.alias("block_type"))


def formula_chunks(blocks: DataFrame, *more: Column) -> DataFrame:
    """A chunk for each formula with the block before and after it, and with ``more`` columns of its block."""
    w = Window.partitionBy("doc_id").orderBy("block_idx")
    near = F.trim(F.concat(F.lag("text", 1, "").over(w), F.lit(" "), F.col("text"), F.lit(" "), F.lead("text", 1, "").over(w)))
    rows = blocks.withColumn("near", near).filter("block_type = 'formula'")
    return rows.select(
        F.format_string("%d/formula_%05d", "doc_id", F.col("block_idx") - 1).alias("chunk_id"), "doc_id", (F.col("doc_id") * 1_000_000 + 500_000 + F.col("block_idx")).alias("chunk_ord"), F.col("near").alias("text"),
        "page_number", F.col("page_number").alias("page_end"), "chapter", "section", "subsection", F.array(F.lit("formula")).alias("block_types"), word_count(F.col("near")).alias("token_count"), *more,
    )


def whole_sections(blocks: DataFrame) -> DataFrame:
    """One chunk for each chapter and section of a document, its blocks in order."""
    rows = blocks.groupBy("doc_id", "chapter", "section").agg(F.array_sort(F.collect_list(F.struct("block_idx", "text", "page_number", "block_type"))).alias("b"))
    text = F.array_join(F.col("b.text"), " ")
    first = F.col("b")[0]
    return rows.select(
        F.format_string("%d/%05d", "doc_id", first["block_idx"]).alias("chunk_id"), "doc_id", (F.col("doc_id") * 1_000_000 + first["block_idx"]).alias("chunk_ord"), text.alias("text"),
        first["page_number"].alias("page_number"), F.array_max("b.page_number").alias("page_end"), "chapter", "section", F.lit("").alias("subsection"), F.array_sort(F.array_distinct("b.block_type")).alias("block_types"), word_count(text).alias("token_count"),
    )


class Fold:
    """Chunks of a document's blocks, fed one by one in order; all that is held are the blocks of the chunk at hand.

    A block is (page, chapter, section, subsection, text, type), in the buffer with a mark if it is carried from the chunk before.
    """

    def __init__(self, doc_id: int | None, max_tokens: int, overlap: int, compat: bool):
        self.doc_id, self.max_tokens, self.overlap, self.compat = doc_id, max_tokens, overlap, compat
        self.buf: list[tuple] = []
        self.size = self.n = 0

    def _emit(self) -> tuple:
        buf = self.buf
        head = buf[0] if self.compat else next((b for b in buf if not b[6]), buf[0])
        text = " ".join(b[4] for b in buf)
        self.n += 1
        ord_ = None if self.doc_id is None else self.doc_id * 1_000_000 + self.n - 1
        return (f"{self.doc_id}/chunk_{self.n - 1:05d}", self.doc_id, ord_, text, buf[0][0], buf[-1][0], *head[1:4], sorted({b[5] for b in buf}), len(text.split()))

    def _carry(self) -> None:
        words = " ".join(b[4] for b in self.buf).split()
        last = self.buf[-1]
        if len(words) > self.overlap:
            self.buf = [(*last[:4], " ".join(words[len(words) - self.overlap :]), "paragraph", True)] if self.overlap else []
        else:
            self.buf = [(*b[:6], True) for b in self.buf]
        self.size = sum(len(b[4].split()) for b in self.buf)

    def feed(self, row: tuple) -> Iterator[tuple]:
        own = self.buf[0] if self.compat and self.buf else next((b for b in self.buf if not b[6]), None)
        if row[5] == "heading" and own and (row[1], row[2]) != own[1:3]:
            yield self._emit()
            self._carry()
        self.buf.append((*row, False))
        self.size += len(row[4].split())
        if self.size >= self.max_tokens and row[5] != "formula":
            yield self._emit()
            self._carry()

    def close(self) -> Iterator[tuple]:
        if self.buf and (self.compat or any(not b[6] for b in self.buf)):
            yield self._emit()


def section_chunks(blocks: DataFrame, max_tokens: int = 400, overlap: int = 50, compat: bool = False) -> DataFrame:
    """Heading-aware chunks of at least ``max_tokens`` words or up to the next section, the last ``overlap`` words carried over.

    A long block isn't split and a formula defers the cut. Blocks come sorted by document and place and are folded as they stream by in
    Arrow batches: a task holds a batch, the chunk at hand and the chunks of the batch, however long a document is. ``compat``
    labels a chunk by its first block even if that is carried from the section before, compares headings with it, and keeps a last
    chunk of carried words alone; otherwise carried words never count. Null texts count as empty.
    """
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()]

    def packed(chunks: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunks, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold: Fold | None = None
        for batch in batches:
            made: list[tuple] = []
            for doc_id, *row in zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True):
                if fold is None or fold.doc_id != doc_id:
                    made += fold.close() if fold else ()
                    fold = Fold(doc_id, max_tokens, overlap, compat)
                made += fold.feed(tuple(row))
            if made:
                yield packed(made)
        if fold and (made := list(fold.close())):
            yield packed(made)

    # the window sorts each document's blocks, and shuffles them only if they don't lie together yet
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")).alias("_place")
    rows = blocks.select(F.col("doc_id").cast("long"), F.col("page_number").cast("int"), "chapter", "section", "subsection", F.coalesce("text", F.lit("")).alias("text"), "block_type", place)
    return rows.mapInArrow(run, CHUNK_SCHEMA)


def all_chunks(blocks: DataFrame, max_tokens: int = 400, overlap: int = 50, with_formula: bool = False) -> DataFrame:
    """Section and formula chunks together; their ids differ by prefix. ``with_formula``: the formula's own text (formula) besides."""
    more = [F.col("text").alias("formula")] if with_formula else []
    formulas = formula_chunks(blocks, *more).withColumns({"chunk_ord": F.col("chunk_ord").cast("long"), "token_count": F.col("token_count").cast("int")})
    return section_chunks(blocks, max_tokens, overlap).unionByName(formulas, allowMissingColumns=with_formula)


def with_citation(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("citation", citation(F.col("chapter"), F.col("section"), F.col("subsection"), F.col("page_number"), F.col("page_end")))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    formula = F.array_contains("block_types", "formula") & (F.size("block_types") == 1)
    return chunks.groupBy(F.when(formula, "formula").otherwise("section").alias("kind")).agg(F.count("*").alias("n"), F.avg("token_count").alias("mean_tokens"))
