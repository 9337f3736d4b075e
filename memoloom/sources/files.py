"""Text files below folders: every file, also empty ones and those whose names start with `_` or `.`.

Scans select by file metadata, so files of other kinds are not opened. What Spark's scans pass over is added from a complete
listing (`listing.py`), chosen by suffix before anything is read.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoloom.functions.text import clean_text, explode_lines, strip, universal_newlines
from memoloom.sources.listing import passed_over, with_content

# Suffixes of conversation files, in any letter case.
SUFFIXES = (".txt", ".md", ".markdown", ".jsonl")
_SUFFIX = r"(?i)\.(txt|md|markdown|jsonl)$"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths there are; others are reported and left out."""
    context = spark.sparkContext
    hadoop_path, conf = context._jvm.org.apache.hadoop.fs.Path, context._jsc.hadoopConfiguration()
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        place = hadoop_path(path)
        if place.getFileSystem(conf).globStatus(place):
            found.append(path)
        else:
            print(f"input path does not exist: {path}", file=sys.stderr)
    return found


def scan_files(spark: SparkSession, paths: list[str], suffix: str | None = None) -> DataFrame:
    """file (location), length and content of all files below `paths`. A filter on `file` is applied to the listing."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "file string, length bigint, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(found)
    files = _of_kind(files.select(F.col("_metadata.file_path").alias("file"), "length", "content"), suffix)
    rest = _unscanned(spark, found, suffix)
    return files if rest is None else files.union(with_content(rest))


def scan_lines(spark: SparkSession, paths: list[str], suffix: str | None = None) -> DataFrame:
    """file and value of every line below `paths`, large files in splits; a filter on `file` as in `scan_files`."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "file string, value string")
    lines = spark.read.option("recursiveFileLookup", True).text(found)
    lines = _of_kind(lines.select(F.col("_metadata.file_path").alias("file"), "value"), suffix)
    rest = _unscanned(spark, found, suffix, "length > 0")
    if rest is None:
        return lines
    text = F.regexp_replace(F.col("content").cast("string"), r"(\r\n|\r|\n)$", "")
    return lines.union(with_content(rest).select("file", F.explode(F.split(text, r"\r\n|\r|\n"))))


def _unscanned(spark: SparkSession, found: list[str], suffix: str | None, condition: str = "true") -> DataFrame | None:
    """file and length of what Spark's scans pass over, or None when there is no such file: most folders have none, and their
    plans hold nothing but the scan."""
    rest = _of_kind(passed_over(spark, found).where(condition), suffix)
    return None if rest.isEmpty() else rest


def _of_kind(df: DataFrame, suffix: str | None) -> DataFrame:
    return df if suffix is None else df.where(F.col("file").rlike(suffix))


def list_files(spark: SparkSession, paths: list[str], suffix: str | None = _SUFFIX) -> DataFrame:
    """path and length of the files below `paths`, directories taken recursively; suffix None keeps every file."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "path string, length bigint")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(found)
    files = _of_kind(files.select(F.col("_metadata.file_path").alias("file"), "length"), suffix)
    rest = _unscanned(spark, found, suffix)
    return (files if rest is None else files.union(rest)).select(F.col("file").alias("path"), "length")


def decoded(content: Column | str) -> Column:
    """Stripped text of a file's bytes, "" when they are not UTF-8."""
    text = F.try_validate_utf8(F.col(content).cast("string") if isinstance(content, str) else content.cast("string"))
    return F.coalesce(strip(universal_newlines(text)), F.lit(""))


def read_texts(spark: SparkSession, paths: list[str], suffix: str | None = _SUFFIX) -> DataFrame:
    """path and whole stripped text, one row per file."""
    found = scan_files(spark, paths, suffix)
    return found.select(F.col("file").alias("path"), decoded("content").alias("text"))


def read_lines(spark: SparkSession, paths: list[str], suffix: str | None = None) -> DataFrame:
    """path and line for every non-blank line, stripped."""
    found = scan_lines(spark, paths, suffix)
    return explode_lines(found.withColumnRenamed("file", "path"), "value", "line")


def read_json_lines(spark: SparkSession, paths: list[str], suffix: str | None = r"(?i)\.jsonl$") -> DataFrame:
    """path and line of JSON-lines files: as `read_lines`, but only line feeds and carriage returns end a line."""
    found = scan_lines(spark, paths, suffix)
    return clean_text(found.select(F.col("file").alias("path"), F.col("value").alias("line")), "line")
