"""Result sets as JSON: arrays as other tools write them, JSON lines as Spark writes them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memoloom.schemas import JUDGED_RESULT
from memoloom.sources.array_splits import BLOCK_BYTES, array_elements
from memoloom.workspace import fresh_path

#: Elements that a task joins at a time.
_ROWS_AT_ONCE = 512


def read_json_array(spark: SparkSession, paths: list[str], schema: T.StructType = JUDGED_RESULT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per array element; missing fields are null. A file that does not hold an array is an error, and so is an element
    that does not fit the schema. Large files are read by many tasks, in byte ranges."""
    elements = array_elements(spark, paths, strict=True, block_bytes=block_bytes)
    text = F.col("element").cast("string")
    gap = F.raise_error(F.concat(F.lit("empty element in the JSON array: "), "path")).cast("string")
    item = F.from_json(F.when(text == "", gap).otherwise(text), schema, {"mode": "FAILFAST"})
    return elements.select(item.alias("item")).select("item.*")


def write_json_arrays(df: DataFrame, path: str) -> None:
    """The rows as a folder of files that each hold one JSON array, null fields included; an existing folder is an error.

    Every task streams its rows into one array; Spark's commit shows all files or, when the job fails, none.
    """
    write_arrays_of(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})), path)


def write_arrays_of(elements: DataFrame, path: str) -> None:
    """As `write_json_arrays`, from one column of JSON texts without line ends."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS_AT_ONCE):
                texts = batch.column(0).slice(start, _ROWS_AT_ONCE)
                leads = pa.array([lead] + [","] * (len(texts) - 1))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(leads, texts, "")], ["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], ["value"])

    elements.toDF("value").mapInArrow(bracketed, "value string").write.text(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType = JUDGED_RESULT) -> DataFrame:
    """Results written by `write_results`."""
    return spark.read.schema(schema).json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Results as a directory of JSON lines; an existing one is an error."""
    df.write.option("ignoreNullFields", False).json(path)


def replace_results(df: DataFrame, path: str) -> None:
    """Results over the directory they may have been read from.

    The new rows are written to the shared folder first, each run to a place of its own, and the old ones give way only to
    rows that are safely stored.
    """
    staged = fresh_path(df.sparkSession, "results")
    df.write.option("ignoreNullFields", False).json(staged)
    rows = df.sparkSession.read.schema(df.schema).json(staged)
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
