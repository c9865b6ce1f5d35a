"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is taken, in local mode only: on a cluster
    it would be another folder on every machine, so there the setting is required.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="segmenta-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/segmenta/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps neither
    recompute it nor depend on the executors that made it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made with ``new_path``, on whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A :func:`materialize` whose folders are deleted at the end of the block, for tables that
    nothing reads after it."""
    paths = []

    def written(df: DataFrame, label: str) -> DataFrame:
        paths.append(new_path(spark, label))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield written
    finally:
        for path in paths:
            remove(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_DROPPED: list[Callable[[], None]] = []


def kept_by_worker(load: Callable) -> Callable:
    """``load``, whose latest results a Python worker keeps from task to task, up to :func:`drop_kept`."""
    kept = functools.lru_cache(maxsize=2)(load)
    _DROPPED.append(kept.cache_clear)
    return kept


def drop_kept() -> None:
    """Frees what earlier operators keep in this Python worker: Spark hands workers on from one
    operator to the next, and their tables would add up.  Called by tasks that use none of them."""
    for drop in _DROPPED:
        drop()
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that a task's results are handed on piece by piece."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_in(batch: pa.RecordBatch, row: str | None, names: list[str]) -> pa.Array:
    """The texts of a batch: its column ``text``, or that field of the struct ``row`` of ``names``."""
    if row is None:
        return batch.column("text")
    return pc.struct_field(batch.column(row), [[n.lower() for n in names].index("text")])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
