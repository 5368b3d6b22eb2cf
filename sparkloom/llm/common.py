"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, stored  # noqa: F401

#: Text of a batch is worked on in pieces of about so many bytes, which bounds a worker's memory.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that lies in fewer files than there are cores is dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text (null: the empty text) modulo ``k``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % k


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in slices of about ``most`` bytes of text, each with its texts as UTF-8 (null: empty)."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    size, begin = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
    for i, n in enumerate(lengths):
        size += n
        if size >= most or i + 1 == len(lengths):
            yield batch.slice(begin, i + 1 - begin), [x or b"" for x in col.slice(begin, i + 1 - begin).to_pylist()]
            size, begin = 0, i + 1


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
