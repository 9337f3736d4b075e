"""Regions of memory vectors, so that a similarity join leaves out what cannot be among the best.

Pivots come from a bounded sample of the memories (one row of each of SAMPLE hash buckets of ids, the same at every size); every
memory belongs to the region of its nearest pivot. A region keeps its number of rows and the least and largest distance to its
pivot. By the triangle inequality no member is nearer to a query than the larger of: its distance to the pivot less the
largest one, the least one less its distance, and half of what the pivot is farther away than the nearest pivot.

A first pass asks the regions nearest to a query until they hold FIRST rows; the k-th score found there is its floor. The
second pass asks every region that can hold a score of at least the floor. Both are exact joins by scope and region, so a
query meets only the regions it was sent to, and the outcome is that of the join without regions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memoloom.workspace import materialized

SAMPLE = 4096
FIRST = 2048
_ROUNDS = 5


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length in float64."""
    lengths = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors differ in length: {sorted(lengths)}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2.0 * (a @ b.T)
    return np.sqrt(square.clip(0.0))


def choose_pivots(sample: np.ndarray, regions: int) -> np.ndarray:
    """Farthest-first starts, moved to the middle of their rows a few times."""
    chosen = [0]
    gap = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(regions, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen]
    for _ in range(_ROUNDS):
        near = _distances(sample, pivots).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(pivots))[:, None]
        pivots = np.where(counts > 0, sums / np.maximum(counts, 1), pivots)
    return pivots


class Regions:
    """Pivots and what is known of their regions; its size depends on the number of regions only."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.pivots, self.metric = pivots, metric
        self.rows = np.zeros(len(pivots), np.int64)
        self.least, self.most = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        """Distances to all pivots, of the vectors the metric compares."""
        if vectors.shape[1] != self.pivots.shape[1]:
            raise ValueError(f"vectors differ in length: {vectors.shape[1]}, regions have {self.pivots.shape[1]}")
        return _distances(_unit(vectors) if self.metric == "cosine" else vectors, self.pivots)

    def nearest_possible(self, distances: np.ndarray) -> np.ndarray:
        """For each query and region, a distance below which it has no member; room for rounding included."""
        bound = np.maximum(distances - self.most, self.least - distances)
        bound = np.maximum(bound, (distances - distances.min(axis=1, keepdims=True)) / 2.0)
        return bound * (1.0 - 1e-9) - 1e-6 * (1.0 + np.abs(self.pivots).max(initial=0.0))

    def reach(self, floor: np.ndarray) -> np.ndarray:
        """The distance at which the score has fallen to the floor."""
        return np.sqrt((1.0 - floor if self.metric == "l2" else 2.0 - 2.0 * floor).clip(0.0))

    def first(self, distances: np.ndarray) -> list[np.ndarray]:
        """The nearest regions of each query, up to FIRST rows."""
        order = np.argsort(np.where(self.rows > 0, distances, np.inf), axis=1)
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        return [o[(b < FIRST) & (self.rows[o] > 0)] for o, b in zip(order, before, strict=True)]

    def left(self, distances: np.ndarray, floor: np.ndarray) -> list[np.ndarray]:
        """All regions that can hold a score of at least the floor."""
        may = (self.nearest_possible(distances) <= self.reach(floor)[:, None]) & (self.rows > 0)
        return [np.flatnonzero(m) for m in may]


def fit(memories: DataFrame, regions: int, metric: str) -> tuple[DataFrame, Regions | None]:
    """The usable memories (id, vector, scope, spread) with their region, stored, and what is known of the regions."""
    place = F.pmod(F.xxhash64("id", "spread"), F.lit(SAMPLE))
    first = F.min_by("vector", F.struct(F.xxhash64("id", "spread"), "id"))
    sample = [r["vector"] for r in memories.groupBy(place.alias("place")).agg(first.alias("vector")).head(SAMPLE)]  # a row for each place
    if not sample:
        return memories.withColumn("region", F.lit(0)), None
    if len({len(v) for v in sample}) > 1:
        raise ValueError(f"vectors differ in length: {sorted({len(v) for v in sample})}")
    table = np.array(sorted(sample), np.float64)
    found = Regions(choose_pivots(_unit(table) if metric == "cosine" else table, regions), metric)

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distances = found.placed(matrix(batch.column("vector")))
                near = distances.argmin(axis=1)
                columns = [*batch.columns, pa.array(near.astype(np.int32)), pa.array(distances[np.arange(len(near)), near])]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "region", "gap"])

    schema = T.StructType([*memories.schema.fields, T.StructField("region", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    stored = materialized(memories.mapInArrow(place_rows, schema), "regions")
    known = stored.groupBy("region").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    for r in known.head(regions):  # a row for each region
        found.rows[r["region"]], found.least[r["region"]], found.most[r["region"]] = r["n"], r["least"], r["most"]
    return stored.drop("gap"), found


def send(queries: DataFrame, regions: Regions, second: bool) -> DataFrame:
    """Queries (query_id, vector, scopes, floor) with the regions they have to ask: the first ones, or all that are left."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distances = regions.placed(matrix(batch.column("vector")))
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                chosen = regions.left(distances, floor) if second else regions.first(distances)
                lists = pa.array([c.astype(np.int32) for c in chosen], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "regions"])

    schema = T.StructType([*queries.schema.fields, T.StructField("regions", T.ArrayType(T.IntegerType()))])
    return queries.mapInArrow(choose, schema)
