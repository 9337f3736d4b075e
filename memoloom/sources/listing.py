"""Complete listings of folders, level by level as Spark jobs, and the files that Spark's own scans pass over.

Spark's scans leave out files without content and names that start with `_` or `.`. These are read here by Python tasks through
the file system that their path names; all others stay with Spark's scans, which read them in splits and push filters
down. The checksum files that a local Hadoop file system keeps beside its files (`.name.crc`) belong to that file system and are not listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoloom.workspace import materialized

_CHECKSUM = re.compile(r"(^|/)\.[^/]*\.crc$")
_LISTED = "path string, length long, folder boolean"
#: Whether Spark's own scans pass a file over: a name of the file or of a folder below the path given that they take for hidden, or no content.
_PASSED_OVER = "(below rlike '(^|/)[_.]' and not below rlike '^[^/]*=') or length = 0"


def roots(spark: SparkSession, paths: list[str]) -> list[str]:
    """What there is at the paths, patterns resolved, as complete locations."""
    context = spark.sparkContext
    hadoop_path, conf = context._jvm.org.apache.hadoop.fs.Path, context._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        place = hadoop_path(path)
        for status in place.getFileSystem(conf).globStatus(place) or []:
            found.append(_uri(unquote(status.getPath().toUri().toString())))
    return found


def _uri(location: str) -> str:
    """`file:/x` in the form that names no host; other locations as they are."""
    return "file://" + location[len("file:") :] if re.match(r"file:/(?!/)", location) else location


def opened(location: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a location, the path in it, and what stands before it."""
    found, inner = fs.FileSystem.from_uri(quote(location, safe="/:@=,+~&;!$'()*"))
    return found, inner, location[: len(location) - len(inner)] if location.endswith(inner) else location.split("://")[0] + "://"


def list_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length and below (the path from the one given on) of every file at and below the paths."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for location, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner, prefix = opened(location)
                own = system.get_file_info(inner)
                infos = [own] if own.is_file else system.get_file_info(fs.FileSelector(inner))
                infos = [i for i in infos if not _CHECKSUM.search(i.path)]
                columns = [[prefix + i.path for i in infos], [i.size or 0 for i in infos], [not i.is_file for i in infos], [root] * len(infos)]
                kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "length", "folder", "root"])

    level = spark.createDataFrame([(r, r) for r in roots(spark, paths)], "path string, root string")
    found = []
    while not level.isEmpty():
        seen = level.repartition("path").mapInArrow(look, f"{_LISTED}, root string")
        seen = materialized(seen, "listing")
        found.append(seen.where("not folder"))
        level = seen.where("folder").select("path", "root")
    if not found:
        return spark.createDataFrame([], "path string, length long, below string")
    below = F.when(F.col("path") == F.col("root"), F.regexp_extract("path", "[^/]*$", 0)).otherwise(F.substr("path", F.length("root") + 2))
    return reduce(DataFrame.union, found).select("path", "length", below.alias("below"))


def passed_over(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file and length of the files that Spark's own scans leave out."""
    return list_all(spark, paths).where(_PASSED_OVER).select(F.col("path").alias("file"), "length")


def with_content(files: DataFrame) -> DataFrame:
    """file, length and content of listed files (file, length), a file at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for location, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner, _ = opened(location)
                with system.open_input_stream(inner) as stream:
                    content = stream.read() if length else b""
                columns = [pa.array([location]), pa.array([length]), pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "length", "content"])

    return files.mapInArrow(read, "file string, length long, content binary")


def touch(names: DataFrame, folder: str) -> None:
    """Make empty files of the names (one column) below an existing folder, as markers for other tools; files that are there stay."""
    (root,) = roots(names.sparkSession, [folder])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, inner, _ = opened(f"{root}/{name}")
                if not system.get_file_info(inner).is_file:
                    system.open_output_stream(inner).close()
            yield batch

    names.toDF("name").mapInArrow(make, "name string").count()
