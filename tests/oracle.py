"""Compare registered queries with DuckDB over the same Parquet files: columns, number of rows, values."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as registered  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _kind(value) -> str:
    return "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, key: str, sf_dir: str) -> tuple[int, str]:
    """Number of rows and "" when equal, else what differs."""
    df = registered.queries()[key](spark, sf_dir)
    got, got_columns = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = registered.oracle_sql().get(key)
    if sql is None:
        return len(got), ""
    result = con.execute(sql)
    want, want_columns = _rows([c[0] for c in result.description], result.fetchall())
    if got_columns != want_columns:
        return len(got), f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}; first got {str(got[:1])[:300]} want {str(want[:1])[:300]}"
    for g, w in zip(got, want):
        if g != w:
            for name, a, b in zip(got_columns, g, w):
                if a != b:
                    return len(got), f"{name}: {str(a)[:300]!r} != {str(b)[:300]!r}"
        for name, a, b in zip(got_columns, g, w):
            if a is not None and _kind(a) != _kind(b):
                return len(got), f"{name}: {type(a)} against {type(b)}"
    return len(got), ""


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="memoloom-oracle-"))
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    keys = sys.argv[2:] or list(registered.queries())
    for key in keys:
        start = time.time()
        try:
            n, problem = compare(spark, con, key, sf_dir)
        except Exception as error:
            n, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok " if not problem and n > 0 else "BAD"
        oracle = "O" if key in registered.oracle_sql() else "-"
        print(f"{mark} {oracle} {key} rows={n} {time.time() - start:.1f}s {problem}", flush=True)


if __name__ == "__main__":
    main()
