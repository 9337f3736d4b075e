"""Where jobs put intermediate tables: the shared folder the cluster names, never a machine-local one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Folder of this application below the shared one: what a run leaves there can be removed by its name."""
    return f"{shared_folder(spark)}/{spark.conf.get('spark.app.id', 'application')}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of this application."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back: a cut in the lineage that survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
