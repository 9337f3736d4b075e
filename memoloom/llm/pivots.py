"""Exact top-k by inner product with pivot-table elimination.

Components are turned into integers. Distances of every vector to many pivots are computed once and stored with it. By the
triangle inequality the distance of a query and a candidate is at least the largest difference of their distances to a
pivot, which bounds the inner product from above. Candidates that lie side by side are a group with one bound, from the
range of its distances; a block has one too. Whatever has a bound below the k-th best exact score found so far is never
evaluated; a query that has not found k yet starts with its group of best bound. What is left is one matrix product. The
result is exact. (A bound for each candidate takes 32 differences, more than its score, and on vectors in 64 dimensions
leaves out hardly more than the bound of its group.)

Candidates are range partitioned by nearest pivot and distance, so a block holds vectors of one region and whole blocks
fall to the bounds; the id is part of that order, so one vector that very many rows share spreads over many blocks. Both
sides are cut into cells: query blocks are copied to every cell of the candidates, and candidate blocks to every part of the
queries. They meet in one sorted stream per cell, which holds its queries while candidates stream by; nothing is joined
or broadcast, the parts depend on the bytes a task may hold, and the copies of the queries take no more room than the
candidates. Pivots come from a bounded, documented sample (the first row of each of ``SAMPLE`` hash buckets of ids); they
affect speed only. The sample also gives each query the first score that its answers must reach.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id. A
shorter vector counts as filled up with zeros. Rows that share an id are candidates each; an id asks once, with the
smallest of its vectors, and none of its own rows answers. An empty table, or no query rows, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memoloom.llm.storage import dropped, give_back, small_batches, written

SCALE = 1024
PIVOTS = 32
SAMPLE = 2048
QUERY_BLOCK = 512
BLOCK = 1024
#: Candidates with one bound.
GROUP = 64
#: Queries of one matrix product; hits that wait to be sorted in.
TOGETHER = 1024
WAITING = 1 << 16
#: Bytes of a stored block's vectors (8 for each component), and of the queries that a task holds.
BLOCK_BYTES = 1 << 19
HELD_BYTES = 192 << 20
_LOWEST = np.iinfo(np.int64).min


def integer_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, kept columns, vector): floor(scale * x) of every component of the rows that take part."""
    usable = F.col(id_col).isNotNull() & F.forall(vec_col, _finite)
    scaled = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), *keep, scaled.alias("vector"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """One row a list, filled up with zeros."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    dims = int(lengths.max(initial=0))
    if (lengths == dims).all():
        return values.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _wide(a: np.ndarray, dims: int) -> np.ndarray:
    return a if a.shape[1] == dims else np.pad(a, ((0, 0), (0, dims - a.shape[1])))


def _squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a, dtype=float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dims = max(a.shape[1], b.shape[1])
    a, b = _wide(a, dims).astype(float), _wide(b, dims).astype(float)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(square.clip(0))


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those chosen before."""
    chosen = [0]
    gap = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(pivots, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _with_nearest(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = _distances(_matrix(batch.column(1)), pivots)
                near = gaps.argmin(1)
                columns = [*batch.columns, pa.array(near.astype(np.int32)), pa.array(gaps[np.arange(len(near)), near])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "near", "gap"])

    return rows.mapInArrow(nearest, "id long, vector array<long>, near int, gap double")


_BLOCK = "n int, dims int, width int, ids binary, vectors binary, gaps binary, floors binary"


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes."""
    for kind in ("<i2", "<i4"):
        if a.min(initial=0) >= np.iinfo(kind).min and a.max(initial=0) <= np.iinfo(kind).max:
            return a.astype(kind)
    return a.astype("<i8")


def _blocks(rows: DataFrame, pivots: np.ndarray, size: int, seed: tuple[np.ndarray, np.ndarray] | None = None, k: int = 0) -> DataFrame:
    """Rows of a task packed into blocks: ids, integer vectors and their row of the pivot table. With candidates (ids,
    vectors) as the seed, also the score that each row's k best must reach."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
            most = min(size, max(GROUP, BLOCK_BYTES // (8 * max(1, vectors.shape[1]))))
            start = 0
            while start < len(ids):
                end = min(len(ids), start + max(1, most - count))
                held.append((ids[start:end], vectors[start:end]))
                count += end - start
                start = end
                if count >= most:
                    yield emit(held)
                    held, count = [], 0
        if count:
            yield emit(held)
        give_back()

    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = np.concatenate([i for i, _ in held]).astype("<i8")
        vectors = _narrow(_stacked([v for _, v in held]))
        gaps = _distances(vectors, pivots).astype("<f4")
        floors = b""
        if seed is not None:
            best = Best(ids, vectors, gaps, k)
            best.meet(*seed, _distances(seed[1], pivots).astype("<f4"))
            floors = best.floors.astype("<i8").tobytes()
        values = (len(ids), vectors.shape[1], vectors.itemsize, ids.tobytes(), vectors.tobytes(), gaps.tobytes(), floors)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["n", "dims", "width", "ids", "vectors", "gaps", "floors"])

    return rows.mapInArrow(pack, _BLOCK)


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    dims = max(p.shape[1] for p in parts)
    return np.concatenate([_wide(p, dims) for p in parts])


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, dims, width = (batch.column(c)[i].as_py() for c in ("n", "dims", "width"))
    ids, vectors, gaps, floors = (batch.column(c)[i].as_buffer() for c in ("ids", "vectors", "gaps", "floors"))
    table = np.frombuffer(gaps, "<f4").reshape(n, -1)
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, f"<i{width}").reshape(n, dims), table, np.frombuffer(floors, "<i8")


class Best:
    """Best k (score, id) of each of the held queries, over the candidate blocks seen so far. ``floors``: scores that a
    query's k best are known to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, gaps: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.gaps = gaps.astype(np.float32)
        self.norms = _squares(vectors)
        self.floors = np.full(len(ids), _LOWEST) if floors is None else floors.copy()
        self.last = np.full(len(ids), np.iinfo(np.int64).max)  # a candidate at the floor gets in up to this id
        self.count = np.zeros(len(ids), np.int64)
        self.scores, self.names = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self._typed = vectors[:0]

    @property
    def found(self) -> list[list[tuple[int, int]]]:
        """(-score, id) of each query, ascending."""
        self._sort_in()
        rows = zip(self.scores, self.names, self.count, strict=True)
        return [list(zip((-s[:n]).tolist(), i[:n].tolist(), strict=True)) for s, i, n in rows]

    def meet(self, ids: np.ndarray, vectors: np.ndarray, gaps: np.ndarray) -> int:
        """Take in a candidate block; returns how many scores were computed."""
        if not len(ids) or not len(self.ids):
            return 0
        norms = _squares(vectors)
        starts = np.arange(0, len(ids), GROUP)
        gaps = gaps.astype(np.float32)
        low, high, top = np.minimum.reduceat(gaps, starts), np.maximum.reduceat(gaps, starts), np.maximum.reduceat(norms, starts)
        mine, theirs = self._same_type(vectors, norms.max())
        theirs = np.ascontiguousarray(theirs.T)
        of_block = self._bounds(np.arange(len(self.ids)), low.min(0)[None], high.max(0)[None], top.max(keepdims=True))[:, 0]
        left = np.flatnonzero(of_block >= self.floors)
        evaluated = 0
        for start in range(0, len(left), TOGETHER):
            part = left[start : start + TOGETHER]
            bounds = self._bounds(part, low, high, top)
            new = np.flatnonzero(self.floors[part] == _LOWEST)
            if len(new) and len(starts) > 1:
                first = np.zeros(bounds.shape, bool)
                first[new, bounds[new].argmax(1)] = True
                evaluated += self._evaluate(part, first & (bounds >= self.floors[part, None]), mine, theirs, ids)
                self._sort_in()
                bounds[first] = -np.inf
            open_groups = (bounds >= self.floors[part, None]) & (bounds > -np.inf)
            evaluated += self._evaluate(part, open_groups, mine, theirs, ids)
            if self.waiting > WAITING:
                self._sort_in()
        return evaluated

    def _same_type(self, vectors: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
        """Both sides in the smallest type that holds every partial sum of every product exactly."""
        largest = float(np.sqrt(self.norms.max() * largest)) * (1 + 1e-6)
        exact = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64 if largest < 2**62 else object
        dims = max(self.vectors.shape[1], vectors.shape[1])
        if self._typed.dtype != exact or self._typed.shape[1:] != (dims,) or len(self._typed) != len(self.ids):
            self._typed = _wide(self.vectors, dims).astype(exact)
        return self._typed, _wide(vectors, dims).astype(exact)

    def _bounds(self, part: np.ndarray, low: np.ndarray, high: np.ndarray, top: np.ndarray) -> np.ndarray:
        """For each query and group, what no inner product of integers is above; half a unit covers rounding."""
        own, norms = np.ascontiguousarray(self.gaps[part].T), self.norms[part]
        apart, gap = np.zeros((len(low), len(part)), np.float32), np.empty((len(low), len(part)), np.float32)
        for p in range(len(own)):
            np.maximum(apart, np.subtract(low[:, p, None], own[p], out=gap), out=apart)
            np.maximum(apart, np.subtract(own[p], high[:, p, None], out=gap), out=apart)
        # gaps are rounded to 24 bits; their squares are exact up to 53
        reach = np.sqrt(norms)[:, None] + np.sqrt(top) + own.max(0, initial=0.0)[:, None] + high.max(1, initial=0.0)
        blur = 2.0**-22 if reach.max() ** 2 < 2**50 else 2.0**-22 + 2.0**-24 * np.sqrt(self.vectors.shape[1] + 4)
        apart = (apart.T - blur * reach).clip(0)
        sums = norms[:, None] + top
        return (sums - apart * apart) / 2 + 0.5 + 1e-9 * sums

    def _evaluate(self, part: np.ndarray, groups: np.ndarray, mine: np.ndarray, theirs: np.ndarray, ids: np.ndarray) -> int:
        """Score these groups of these queries: in one product if most of them are asked, else group by group."""
        if groups.mean() > 0.5:
            scores = mine[part] @ theirs
            rows, columns = self._reached(part, scores)
            asked = groups[rows, columns // GROUP]
            rows, columns = rows[asked], columns[asked]
            self._take(part[rows], scores[rows, columns], ids[columns])
            return scores.size
        evaluated = 0
        for g in np.flatnonzero(groups.any(0)):
            those = part[groups[:, g]]
            scores = mine[those] @ theirs[:, g * GROUP : (g + 1) * GROUP]
            rows, columns = self._reached(those, scores)
            self._take(those[rows], scores[rows, columns], ids[g * GROUP + columns])
            evaluated += scores.size
        return evaluated

    def _reached(self, part: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reached = scores >= self.floors[part].astype(scores.dtype)[:, None]
        return np.divmod(np.flatnonzero(reached), scores.shape[1])

    def _take(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.dtype == object:
            if any(s > np.iinfo(np.int64).max for s in scores):
                raise OverflowError("a score is beyond 64 bits")
            scores = np.array([max(s, _LOWEST) for s in scores], np.int64)
        scores = scores.astype(np.int64)
        keep = (ids != self.ids[queries]) & ((scores > self.floors[queries]) | (ids <= self.last[queries]))
        if keep.any():
            self.hits.append((queries[keep], scores[keep], ids[keep]))
            self.waiting += len(self.hits[-1][0])

    def _sort_in(self) -> None:
        if not self.hits:
            return
        queries, scores, ids = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        self.hits, self.waiting = [], 0
        changed = np.unique(queries)
        held = np.arange(self.k) < self.count[changed, None]
        queries = np.concatenate([np.repeat(changed, self.count[changed]), queries])
        scores = np.concatenate([self.scores[changed][held], scores])
        ids = np.concatenate([self.names[changed][held], ids])
        order = np.lexsort((ids, ~scores, queries))  # ~: descending, without overflow
        queries, scores, ids = queries[order], scores[order], ids[order]
        begins = np.searchsorted(queries, changed)
        rank = np.arange(len(queries)) - np.repeat(begins, np.diff([*begins, len(queries)]))
        best = rank < self.k
        self.scores[queries[best], rank[best]], self.names[queries[best], rank[best]] = scores[best], ids[best]
        self.count[changed] = np.minimum(np.diff([*begins, len(queries)]), self.k)
        full = changed[self.count[changed] == self.k]
        self.floors[full], self.last[full] = self.scores[full, -1], self.names[full, -1]

    def results(self, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        self._sort_in()
        if any((self.scores[i, : self.count[i]] == _LOWEST).any() for i in np.flatnonzero((self.scores == _LOWEST).any(1))):
            raise OverflowError("a score is beyond 64 bits")
        held = np.arange(self.k) < self.count[:, None]
        columns = (np.repeat(self.ids, self.count), self.names[held], self.scores[held])
        for start in range(0, len(columns[0]), rows):
            arrays = [pa.array(c[start : start + rows], pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])


def _meet(k: int):
    """Reads cells one after another: first a cell's queries, which are held, then its candidates, which stream by."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                now = (batch.column("part")[i].as_py(), batch.column("cell")[i].as_py())
                if now != cell:
                    if best is not None:
                        yield from best.results()
                    cell, held, best = now, [], None
                if batch.column("side")[i].as_py() == 0:
                    held.append(tuple(x.copy() for x in _unpacked(batch, i)))
                    continue
                if best is None:
                    if not held:
                        continue  # a part without queries
                    ids, vectors, gaps, floors = zip(*held, strict=True)
                    best = Best(np.concatenate(ids), _stacked(list(vectors)), np.concatenate(gaps), k, np.concatenate(floors))
                    held = []
                best.meet(*_unpacked(batch, i)[:3])
        if best is not None:
            yield from best.results()
        give_back()

    return task


def cell_plan(queries: int, candidates: int, dims: int, k: int, partitions: int, cores: int) -> tuple[int, int]:
    """Parts of the queries and cells of the candidates. A query is copied to every cell, a candidate to every part: queries
    are cut by what a task can hold, candidates as far as the copies of the queries take half their room; if that
    gives too few tasks, queries are cut further."""
    held = dims * 12 + PIVOTS * 4 + k * 16 + 64
    parts = max(1, -(-queries * held // HELD_BYTES))
    cells = max(1, min(-(-partitions // parts), candidates // (2 * queries), -(-candidates // BLOCK)))
    most = -(-queries // QUERY_BLOCK)
    return max(parts, min(most, -(-min(2 * cores, partitions) // cells))), cells


def search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates (id, vector) of each query (id, vector), ties to smaller ids."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    place = F.pmod(F.xxhash64("id"), F.lit(SAMPLE))
    first = vectors.groupBy(place.alias("place")).agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "vector")).alias("first"))
    sample = first.select("first.*").toArrow().sort_by([("h", "ascending"), ("id", "ascending")])  # at most a row for each bucket
    if not sample.num_rows:
        return spark.createDataFrame([], empty)
    seed = (sample.column("id").combine_chunks().to_numpy(), _narrow(_matrix(sample.column("vector").combine_chunks())))
    pivots = choose_pivots(seed[1])
    placed = _with_nearest(vectors, pivots).repartitionByRange("near", "gap", "id").sortWithinPartitions("near", "gap", "id")
    asked = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    with small_batches(spark, 1024):
        blocks = written(_blocks(placed.select("id", "vector"), pivots, BLOCK), "pivot-blocks")
        asked = written(_blocks(asked, pivots, QUERY_BLOCK, seed, k), "pivot-queries")
    many = F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    n_asked, dims = asked.agg(many, F.max("dims")).first()
    if not n_asked:
        dropped(blocks)
        return spark.createDataFrame([], empty)
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cores = spark.sparkContext.defaultParallelism
    parts, cells = cell_plan(n_asked, blocks.agg(many).first()["n"], dims, k, partitions, cores)
    stream = _stream(asked, blocks, parts, cells, max(partitions, 4 * parts * cells))
    found = stream.mapInArrow(_meet(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    with small_batches(spark, 16):  # blocks are large rows
        ranked = written(ranked.select("query_id", "rank", "vec_id", "score"), "pivot-ranks")
    dropped(blocks)
    dropped(asked)
    return ranked


def _stream(asked: DataFrame, blocks: DataFrame, parts: int, cells: int, tasks: int) -> DataFrame:
    """Query blocks in every cell, candidate blocks in every part; sorted, a cell's queries first."""

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumns({"part": dealt(parts), "side": F.lit(0)}).withColumn("cell", each(cells))
    right = blocks.withColumns({"cell": dealt(cells), "side": F.lit(1)}).withColumn("part", each(parts))
    return left.unionByName(right).repartition(tasks, "part", "cell").sortWithinPartitions("part", "cell", "side")


def nearest_to_every(vectors: DataFrame, k: int = 10, step: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The search of all rows whose id is divisible by the step against all rows."""
    rows = integer_vectors(vectors, id_col, vec_col)
    return search(rows.where(F.col("id") % step == 0), rows, k)
