"""Session helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers that start from now on import this package from where it lies (clusters that install it don't need this)."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    return spark


_stored: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a new temporary one in local mode (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path of its own in the shared folder, that ``clear_stored`` removes."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: the lineage ends there and a lost executor costs nothing."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored_small(df: DataFrame, conf: dict[str, str] | None = None, **options: object) -> DataFrame:
    """``stored`` for large tables: packed more tightly, and shuffle files of the write go when it ends, not when the driver collects its garbage.

    ``conf`` holds for the write, ``options`` are the writer's. Not for sides of joins whose broadcast Spark judges by the size of files.
    """
    path = new_path(df.sparkSession)
    with _settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (conf or {})):
        df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Remove all tables that this session has stored. Results that still read them must have been written or collected before."""
    jvm = spark.sparkContext._jvm
    for path in _stored.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
