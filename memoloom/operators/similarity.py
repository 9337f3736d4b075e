"""Exact top-k similarity join of query vectors against memory vectors.

Both sides are cut into cells by scope and by hash; queries and memories of a cell meet in one sorted stream, and every
cell passes on at most k rows per query. A cell's queries are held and its memories stream by, so queries are cut by the
bytes a task may hold and memories only as far as the number of tasks asks for: that keeps |Q| * mp + |M| * qp, the rows that
are shuffled, small. No task depends on how rows are spread over scopes. Without regions nothing runs before the result is
asked for. With regions (`regions.py`) a query meets only the memories that can be among its best.

Rows are never paired up in Spark: pairs exist only inside a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memoloom.functions.vectors import all_finite
from memoloom.operators.regions import fit, send
from memoloom.operators.topk import METRICS, RunningTopK
from memoloom.schemas import DEFAULT_MIN_SCORE, DEFAULT_TOP_K
from memoloom.workspace import materialized

# A cell holds its queries: bytes that they may take in a task, and bytes for each of their components and of their k hits
# (number, score, id, held and pending).
HELD_BYTES = 96 << 20
HELD_PER_COMPONENT = 8
HELD_PER_HIT = 160
# Memories stream by; a cell with fewer is not worth a task. Cells wanted for each shuffle partition.
LEAST_MEMORIES = 4096
CELLS_PER_PARTITION = 2
# Rows of a scope below which it is not looked at when cells are planned.
SMALL = 4096
# Scopes cut apart. A scope beyond the largest 100,000 holds less than 1/100,000 of its side and stays whole.
MAX_CUT_SCOPES = 100_000

_ALL = "*"


def top_k(df: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows per query with their 1-based rank; ties go to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(
    queries: DataFrame,
    memories: DataFrame,
    *,
    k: int = DEFAULT_TOP_K,
    min_score: float | None = DEFAULT_MIN_SCORE,
    metric: str = "l2",
    query_id: str = "query_id",
    query_vector: str = "vector",
    query_scopes: str | None = None,
    memory_id: str = "id",
    memory_vector: str = "vector",
    memory_scope: str = "scope",
    spread_by: tuple[str, ...] = (),
    regions: int | None = None,
) -> DataFrame:
    """query_id, id, score, rank of the k best memories per query with score >= min_score.

    A query or memory whose vector is null or has a component that is null, NaN or infinite takes no part; it costs no
    other row anything.

    `query_scopes` names an ARRAY<STRING> column with the scopes a query may read; null means all memories. Query ids
    must be unique. `spread_by` names further memory columns (e.g. a row position) that tell copies with equal ids
    apart when cells are formed. `regions` asks for that many regions of memories (a few times the square root of their number
    in millions is enough); the memories are then stored once with their region, and the rows are the same.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be positive")
    scopes = F.col(query_scopes) if query_scopes else F.lit(None)
    q = queries.select(
        F.col(query_id).alias("query_id"),
        F.col(query_vector).cast("array<float>").alias("vector"),
        scopes.cast("array<string>").alias("scopes"),
    )
    scope = F.col(memory_scope) if query_scopes else F.lit(None).cast("string")
    m = memories.select(
        F.col(memory_id).alias("id"),
        F.col(memory_vector).cast("array<float>").alias("vector"),
        scope.alias("scope"),
        F.xxhash64(memory_id, *spread_by).alias("spread"),
    )

    lowest = float("-inf") if min_score is None else float(min_score)
    q = q.withColumn("floor", F.lit(lowest))
    if regions is None:
        return top_k(_meet_in_cells(q, m, k, metric), k)
    m, known = fit(m.where(_usable()), regions, metric)
    if known is None:
        return top_k(_meet_in_cells(q, m.drop("region"), k, metric), k)
    q = q.where(_usable())
    found = materialized(_meet_in_cells(send(q, known, False), m, k, metric), "first-hits")
    kth = top_k(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("asked"), F.col("score").alias("kth"))
    raised = q.join(kth, F.col("query_id") == F.col("asked"), "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", "floor")))
    return top_k(_meet_in_cells(send(raised.select(*q.columns), known, True), m, k, metric), k)


# ---------------------------------------------------------------------------------------------- cells


def _counts(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    """Rows of the keys with more than SMALL of them, and of the key of all memories."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias(name), *more)
    large = counts.where((F.col(name) > SMALL) | (F.col("key") == _ALL))
    return large.orderBy((F.col("key") == _ALL).desc(), F.desc(name)).limit(MAX_CUT_SCOPES)


def cell_plan(queries: Column, memories: Column, dimension: Column, cells: Column, k: int = 0) -> tuple[Column, Column]:
    """Parts of the queries and of the memories of a key that may have so many cells.

    A query is copied to every part of the memories, a memory to every part of the queries. Queries are cut by what a task
    can hold and no further, memories by the cells that leaves.
    """
    held = dimension * HELD_PER_COMPONENT + k * HELD_PER_HIT
    qp = F.greatest(F.ceil(queries * held / HELD_BYTES), F.lit(1))
    mp = F.greatest(F.least(F.ceil(cells / qp), F.ceil(memories / LEAST_MEMORIES)), F.lit(1))
    return qp.cast("int"), mp.cast("int")


def _planned(q: DataFrame, m: DataFrame, k: int = 0) -> DataFrame:
    """key, qp, mp of the large keys: at most 2 x MAX_CUT_SCOPES short rows. Cells are shared out by the pairs of a key."""
    wanted = CELLS_PER_PARTITION * int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = _counts(q, "nq", F.max(F.size("vector")).alias("dimension")).join(_counts(m, "nm"), "key", "full_outer")
    nq, nm = (F.coalesce(F.col(c), F.lit(SMALL)).cast("double") for c in ("nq", "nm"))
    share = wanted * nq * nm / F.sum(nq * nm).over(Window.partitionBy())
    qp, mp = cell_plan(nq, nm, F.coalesce("dimension", F.lit(1)), share, k)
    return counts.select("key", qp.alias("qp"), mp.alias("mp"))


def _usable() -> Column:
    """Whether a row's vector can be compared."""
    return F.coalesce(all_finite("vector"), F.lit(False))


def _part(spread: Column, parts: Column) -> Column:
    return F.pmod(spread, parts).cast("int")


def _each(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _meet_in_cells(q: DataFrame, m: DataFrame, k, metric) -> DataFrame:
    # A key is one scope's memories, or all memories for queries without scopes; with regions, those of one region.
    named = F.transform(F.array_distinct(F.array_compact("scopes")), lambda s: F.concat(F.lit("="), s))
    q = q.withColumn("key", F.explode(F.coalesce(named, F.array(F.lit(_ALL)))))
    keys = F.array_compact(F.array(F.concat(F.lit("="), F.col("scope")), F.lit(_ALL)))
    m = m.withColumn("key", F.explode(keys))
    if "region" in m.columns:
        named = F.concat("key", F.lit("#"), F.col("region").cast("string"))
        q = q.withColumn("region", F.explode("regions")).withColumn("key", named)
        m = m.withColumn("key", named)

    asked = q.select("key").distinct()
    m = m.join(asked, "key", "left_semi")
    # Both sides use the same plan. The counts of the memories read the scopes only, not the vectors.
    parts = F.broadcast(_planned(q, m, k))
    qp, mp = F.coalesce("qp", F.lit(1)), F.coalesce("mp", F.lit(1))

    id_type, memory_id_type = q.schema["query_id"].dataType, m.schema["id"].dataType
    left = q.where(_usable()).join(parts, "key", "left").select(
        "key",
        _part(F.xxhash64("query_id"), qp).alias("qn"),
        _each(mp).alias("mn"),
        F.lit(0).alias("side"),
        "query_id",
        F.lit(None).cast(memory_id_type).alias("id"),
        "vector",
        "floor",
    )
    right = m.where(_usable()).join(parts, "key", "left")
    right = right.select(
        "key",
        _each(qp).alias("qn"),
        _part(F.col("spread"), mp).alias("mn"),
        F.lit(1).alias("side"),
        F.lit(None).cast(id_type).alias("query_id"),
        "id",
        "vector",
        F.lit(None).cast("double").alias("floor"),
    )
    cell = ["key", "qn", "mn"]
    # few bytes that stand for very many pairs: the number of tasks is told, as sizes say nothing
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = left.unionByName(right).repartition(tasks, *cell).sortWithinPartitions(*cell, "side")
    out = _hit_type(id_type, memory_id_type)
    return stream.mapInArrow(_cell_scanner(k, metric, _arrow(out)), out)


def _cell_scanner(k, metric, schema):
    """Reads cells one after another: first a cell's queries, which are held, then its memories, which stream by."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, running = None, [], None
        for batch in batches:
            for piece in _runs(batch):
                now = tuple(piece.column(c)[0].as_py() for c in ("key", "qn", "mn"))
                if now != cell:
                    if running is not None:
                        yield from _hits(running, schema)
                    cell, held, running = now, [], None
                if piece.column("side")[0].as_py() == 0:
                    held.append(piece.select(["query_id", "vector", "floor"]))
                    continue
                if not held and running is None:
                    continue  # a scope nobody asks for
                if running is None:
                    ids = np.concatenate([p.column("query_id").to_numpy(zero_copy_only=False) for p in held])
                    vectors = np.concatenate([_matrix(p.column("vector")) for p in held])
                    floors = np.concatenate([p.column("floor").to_numpy(zero_copy_only=False) for p in held])
                    running, held = RunningTopK(ids, vectors, k, floors, metric), []
                running.add(
                    piece.column("id").to_numpy(zero_copy_only=False),
                    _matrix(piece.column("vector"), running.vectors.shape[1]),
                )
        if running is not None:
            yield from _hits(running, schema)

    return scan


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows that share cell and side."""
    n = batch.num_rows
    if not n:
        return
    change = np.zeros(n - 1, dtype=bool)
    for name in ("key", "qn", "mn", "side"):
        column = batch.column(name)
        change |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    for start, end in zip(edges, edges[1:]):
        yield batch.slice(start, end - start)


# ---------------------------------------------------------------------------------------------- Arrow


def _matrix(lists: pa.Array, dimensions: int | None = None) -> np.ndarray:
    """Rows of equal length as a matrix."""
    lengths = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(lengths) != 1 or (dimensions is not None and lengths[0] != dimensions):
        raise ValueError(f"vectors differ in length: {sorted(lengths)}, queries have {dimensions}")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, lengths[0])


def _hit_type(query_id_type, memory_id_type) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_id_type),
            T.StructField("id", memory_id_type),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _hits(running: RunningTopK, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for result in running.results():
        columns = [pa.array(result[field.name].to_numpy(), field.type) for field in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
