"""Written intermediate tables of long jobs, and batches cut small."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from memoloom.workspace import materialized

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back; its shuffle files go as soon as it stands there, so a job of
    many steps holds those of one step at a time."""
    spark = df.sparkSession
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        return materialized(df, name)
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def dropped(df: DataFrame) -> None:
    """Remove the files of a frame that ``written`` gave and that nothing reads any more."""
    files = df.inputFiles()
    if files:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Jobs started inside send whole texts to workers in small batches: a batch stands in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def cut_sized(batches: Iterator[pa.RecordBatch], text: int, rows: int = 1024, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows, which end with the row that brings their texts to ``size`` bytes."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            full = int(np.searchsorted(ends, size + (int(ends[start - 1]) if start else 0))) + 1
            end = min(full, start + rows, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system; a worker process lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
