"""The memory table: a Parquet directory whose vector column carries its dimension as field metadata.

A keyed table keeps the rows of every run under a key of the run's own (`run=<key>`): appending again with a key puts the new rows
in the place of the old ones, so a job that is repeated, or failed half way, gives its rows once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from memoloom.functions.vectors import all_finite
from memoloom.schemas import memory_schema

_DIMENSION = "dimension"
_RUN = "run"
#: Key of the part that holds the schema of a keyed table and no rows.
CREATED = "created"
# Writer options: Bloom filters over the ids, as large as the number of ids in a row group asks for.
_ID_FILTER = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def _with_dimension(schema: T.StructType, dimension: int) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, f.dataType, f.nullable, {_DIMENSION: dimension}) if f.name == "vector" else f
            for f in schema
        ]
    )


def open_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None when there is none."""
    try:
        return spark.read.parquet(path).drop(_RUN)
    except AnalysisException:
        return None


def create_table(spark: SparkSession, path: str, dimension: int, mode: str = "pro", keyed: bool = False) -> DataFrame:
    """Open the table or create it empty; an existing table is never touched, nor made a keyed one."""
    if dimension <= 0:
        raise ValueError("dimension must be positive")
    table = open_table(spark, path)
    if table is None:
        schema = _with_dimension(memory_schema(mode), dimension)
        place = f"{path}/{_RUN}={CREATED}" if keyed else path
        spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(place)
        table = open_table(spark, path)
    return table


def table_dimension(table: DataFrame) -> int:
    return table.schema["vector"].metadata[_DIMENSION]


def table_mode(table: DataFrame) -> str:
    return "pro" if "scope" in table.columns else "basic"


def checked_vector(vector: Column | str, dimension: int) -> Column:
    """The vector, or an error when its length differs or a component is null, NaN or infinite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    message = F.concat(
        F.lit(f"vector dimension mismatch: expected {dimension} finite components, got "),
        F.coalesce(F.size(v).cast("string"), F.lit("null")),
    )
    fits = F.coalesce((F.size(v) == dimension) & all_finite(v), F.lit(False))
    return F.when(fits, v.cast("array<float>")).otherwise(F.raise_error(message).cast("array<float>"))


def table_rows(entries: DataFrame, dimension: int, mode: str = "pro") -> DataFrame:
    """Stored entries in the columns of the table, vectors checked."""
    names = memory_schema(mode).fieldNames()
    rows = entries.withColumn("vector", checked_vector("vector", dimension))
    return rows.select(*[F.col(name).cast(memory_schema(mode)[name].dataType).alias(name) for name in names])


def append(entries: DataFrame, path: str, run_key: str | None = None) -> int:
    """Append stored entries and return how many there were. Nothing is compared with rows already there.

    A keyed table asks for a `run_key`: its rows replace those of an earlier run with the same key when the job commits, and
    a failed job leaves the earlier ones. Entries must not be read from the part that they replace.

    Rows are sorted by scope within each task, without a shuffle, so that a search by scope skips row groups; Bloom
    filters over the ids do the same for a lookup of a few memories.
    """
    spark = entries.sparkSession
    table = spark.read.parquet(path)
    if (_RUN in table.columns) != (run_key is not None) or run_key in (CREATED, ""):
        raise ValueError(f"a keyed table, and no other, takes a run key (not {CREATED!r} or empty): got {run_key!r}")
    dimension, mode = table_dimension(table), table_mode(table)
    rows = table_rows(entries, dimension, mode)
    order = ["scope", "id"] if mode == "pro" else []
    if run_key is not None:
        rows, order = rows.withColumn(_RUN, F.lit(run_key)), [_RUN, *order]
    if order:
        rows = rows.sortWithinPartitions(*order)
    counted = Observation(f"append-{uuid.uuid4().hex}")
    rows = rows.observe(counted, F.count(F.lit(1)).alias("rows"))
    rows = rows.withMetadata("vector", {_DIMENSION: dimension})
    if run_key is None:
        rows.write.mode("append").options(**_ID_FILTER).parquet(path)
    else:
        keyed = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_RUN)
        keyed.options(**_ID_FILTER).parquet(path)
    return int(counted.get["rows"])


def inspect(table: DataFrame) -> DataFrame:
    """One row: number of rows, smallest and largest vector length, and the row with the smallest id as a sample.

    No vector is read: rows come from the counts in the file footers, the length from the schema, as `append` lets no other in
    (the vectors are looked at only where the schema names no length). The sample takes a scan of the ids and, with the smallest
    one as a pushed filter, of the row groups that can hold it. An empty table has null lengths and no sample; rows with a null
    id are a sample only of a table without other ids.
    """
    shown = [c for c in table.columns if c not in ("vector", "id")]
    rows = table.agg(F.count(F.lit(1)).alias("rows"))
    smallest = table.agg(F.min("id")).scalar()
    sample = table.where(F.col("id").eqNullSafe(smallest)).agg(F.min(F.struct("id", *shown)).alias("sample"))
    if _DIMENSION in table.schema["vector"].metadata:
        length = F.when(F.col("rows") > 0, F.lit(table_dimension(table)))
        rows = rows.select("rows", length.alias("min_dimension"), length.alias("max_dimension"))
    else:
        size = F.size("vector")
        rows = table.agg(F.count(F.lit(1)).alias("rows"), F.min(size).alias("min_dimension"), F.max(size).alias("max_dimension"))
    return rows.select("*", sample.scalar().alias("sample"))
