"""What the corpus operators share: reading tables, shared storage, bounded blocks of texts, memory of workers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns are pruned at the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[df[f"`{c}`"] for c in columns]) if columns else df


def col(name: str, of: str | None = None) -> Column:
    """A column by its whole name, dots and backticks included, optionally of an aliased table or a struct."""
    quoted = f"`{name.replace('`', '``')}`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (plain tests), a checkpoint folder under the warehouse is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows are written to the shared folder once and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def qualified(spark: SparkSession, path: str) -> str:
    """The whole URI of a path, with the file system that Spark takes it for: executors open it without Spark."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder name in the shared storage."""
    return qualified(spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")


def blocks(texts: list[str], size: int) -> Iterator[tuple[int, list[str]]]:
    """(place, texts) of runs of texts of at most ``size`` code points, or of one longer text."""
    k = 0
    while k < len(texts):
        stop, held = k, 0
        while stop < len(texts) and (stop == k or held + len(texts[stop]) < size):
            held += len(texts[stop]) + 1
            stop += 1
        yield k, texts[k:stop]
        k = stop


_stores: list = []


def stored(f):
    """A cached function whose results a worker keeps from task to task, until a task of another operator ends in it."""
    _stores.append(f)
    return f


def release(own=None) -> None:
    """Hand a worker's unused memory back: workers live on after a task, beside those of later stages."""
    for f in _stores:
        if f is not own:
            f.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(found: Iterable[pa.RecordBatch], own=None) -> Iterator[pa.RecordBatch]:
    """The batches of a task, whose worker then hands its unused memory back, but for what its ``own`` cached function holds."""
    try:
        yield from found
    finally:
        release(own)
