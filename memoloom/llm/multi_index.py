"""Hard negatives by an inverted multi-index: two half-space codebooks, cells visited by summed half-score bounds.

Vectors are cut into two halves; each half is coded by the nearest entry of its codebook (a few rounds of k-means on a
bounded sample: one row of each of ``SAMPLE`` hash buckets; every row is indexed, and the sample decides cost only). A pair of codes is a
cell. With the radius of an entry (the largest distance of any row to it) no half of a vector scores above <q, c> + |q| r or below
<q, c> - |q| r, so a cell's scores lie between two sums of half bounds. A heap over both sorted lists of half bounds gives the cells
in falling order of their upper sums (the multi-sequence walk) without scoring all of them.

A search asks for the first k rows in each of several score windows. It walks until the cells seen hold ``FIRST`` rows, has
these scored, and takes the k-th score found in each window as its floor. The second walk goes on to the cells that can still hold a score
from floor to ceiling and stops at the first sum below all floors: then every window is certified and the result exact.
Positives are the window of all scores over rows of the same label; negatives the windows that the positives set, over
the other labels. A cell's summary has a bit for each of 63 label classes, so cells without the label are passed over.

Only (asker, cell) rows of the cells that a walk did not rule out are shuffled. Cells are dealt in parts of at most about ``PART`` rows, askers
in groups of ``ASKERS``, so a cell that a third of all rows share spreads over tasks. The summary has one short row for each of CODES x CODES cells.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part. Shorter vectors count
as filled up with zeros. Rows that share an id are rows each: all of them ask, and only the asking row itself never answers.
Ties go to the smaller id. Negative positive scores have empty windows. An empty table, or no anchors, gives no rows. Other columns
are not read, whatever they are called.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memoloom.llm.pivots import integer_vectors
from memoloom.llm.storage import written

SCALE = 256
CODES = 16
SAMPLE = 2048
FIRST = 512
PART = 4096
ASKERS = 1024
LOW, HIGH = -(1 << 62), 1 << 62


def _padded(vectors: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _gaps(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    rows = rows.astype(float)
    square = (rows * rows).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (rows @ entries.T)
    return np.sqrt(square.clip(0))


def codebook(sample: np.ndarray, codes: int = CODES, rounds: int = 8) -> np.ndarray:
    """Entries of one half: farthest-first starts, then k-means."""
    sample = np.unique(sample, axis=0).astype(float)
    chosen = [0]
    gap = _gaps(sample, sample[:1])[:, 0]
    while len(chosen) < min(codes, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _gaps(sample, sample[chosen[-1:]])[:, 0])
    entries = sample[chosen]
    for _ in range(rounds):
        near = _gaps(sample, entries).argmin(1)
        sizes = np.bincount(near, minlength=len(entries))
        sums = np.stack([np.bincount(near, sample[:, d], len(entries)) for d in range(sample.shape[1])], axis=1) if sample.shape[1] else np.zeros((len(entries), 0))
        entries = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], entries)
    return entries


class Cells:
    """Codebooks, radii and the summary of all cells: what a walk needs, of a size that the number of codes bounds."""

    def __init__(self, dims: int, books: list[np.ndarray], radii: list[np.ndarray], counts: np.ndarray, labels: np.ndarray):
        self.dims, self.books, self.radii, self.counts, self.labels = dims, books, radii, counts, labels

    def halves(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vector[: self.dims // 2], vector[self.dims // 2 :]

    def bounds(self, vector: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half: no row with a code scores above the first or below the second."""
        out = []
        for half, book, radii in zip(self.halves(vector.astype(float)), self.books, self.radii, strict=True):
            middle, reach = book @ half, np.sqrt(half @ half) * radii
            slack = 0.5 + 1e-9 * (np.abs(middle) + reach)
            out.append((middle + reach + slack, middle - reach - slack))
        return out

    def walk(self, vector: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """(cell, upper sum, lower sum) in falling order of upper sums."""
        (u1, l1), (u2, l2) = self.bounds(vector)
        first, second = np.argsort(-u1, kind="stable"), np.argsort(-u2, kind="stable")
        heap = [(-(u1[first[0]] + u2[second[0]]), 0, 0)]
        while heap:
            upper, x, y = heapq.heappop(heap)
            i, j = first[x], second[y]
            yield int(i) * len(u2) + int(j), -upper, float(l1[i] + l2[j])
            if y + 1 < len(second):
                heapq.heappush(heap, (-(u1[i] + u2[second[y + 1]]), x, y + 1))
            if y == 0 and x + 1 < len(first):
                heapq.heappush(heap, (-(u1[first[x + 1]] + u2[j]), x + 1, 0))

    def may_hold(self, cell: int, bit: int, same: bool) -> bool:
        """Whether the cell can have rows of the label class (same), or of any other label."""
        present = int(self.labels[cell])
        return bool(self.counts[cell]) and (not same or bool(present >> bit & 1))


def _label_bit(label: Column) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(63)).cast("int")


def build(vectors: DataFrame) -> tuple[DataFrame, Cells | None]:
    """The index (row, id, label, vector, cell) of rows (id, label, vector), and its cells."""
    place = F.pmod(F.xxhash64("id"), F.lit(SAMPLE))
    first = vectors.groupBy(place.alias("place")).agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "vector")).alias("first"))
    sample = first.select("first.vector").collect()  # at most a row for each bucket
    if not sample:
        return vectors.withColumn("row", F.lit(0)).withColumn("cell", F.lit(0)), None
    dims = vectors.agg(F.max(F.size("vector"))).first()[0]
    table = _padded(sorted(r["vector"] for r in sample), dims)
    books = [codebook(table[:, : dims // 2]), codebook(table[:, dims // 2 :])]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _padded(batch.column(2).to_pylist(), dims)
                gaps = [_gaps(rows[:, : dims // 2], books[0]), _gaps(rows[:, dims // 2 :], books[1])]
                near = [g.argmin(1) for g in gaps]
                far = [g[np.arange(len(rows)), n] for g, n in zip(gaps, near, strict=True)]
                columns = [*batch.columns, *[pa.array(n.astype(np.int32)) for n in near], *map(pa.array, far)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "vector", "i", "j", "far_i", "far_j"])

    coded = vectors.select("id", "label", "vector").mapInArrow(code, "id long, label long, vector array<long>, i int, j int, far_i double, far_j double")
    cell = F.col("i") * len(books[1]) + F.col("j")
    index = written(coded.withColumn("cell", cell).withColumn("row", F.monotonically_increasing_id()), "multi-index")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _label_bit(F.col("label"))))
    summary = index.groupBy("i", "j", "cell").agg(F.count("*").alias("n"), bits.alias("labels"), F.max("far_i").alias("far_i"), F.max("far_j").alias("far_j"))
    radii = [np.zeros(len(b)) for b in books]
    counts, labels = (np.zeros(len(books[0]) * len(books[1]), np.int64) for _ in range(2))
    for r in summary.collect():  # at most CODES * CODES rows
        counts[r["cell"]], labels[r["cell"]] = r["n"], r["labels"]
        radii[0][r["i"]], radii[1][r["j"]] = max(radii[0][r["i"]], r["far_i"]), max(radii[1][r["j"]], r["far_j"])
    radii = [r * (1 + 1e-9) + 1e-6 for r in radii]
    return index.select("row", "id", "label", "vector", "cell"), Cells(dims, books, radii, counts, labels)


_ASKER = "asker long, asker_id long, label long, vector array<long>, lows array<long>, highs array<long>"


def routes(askers: DataFrame, cells: Cells, same: bool, first: bool) -> DataFrame:
    """(cell, asker columns): the cells to score for each asker; the first ones, or those left until all windows are certified.

    ``lows`` and ``highs`` are the windows, the floors of the first scores counting as lows in the second walk."""
    names = [c.split()[0] for c in _ASKER.split(", ")]

    def chosen(vector, bit, lows, highs) -> list[int]:
        lows, highs = np.array(lows, float), np.array(highs, float)
        if not len(lows):
            return []
        floor, held, out = lows.min(), 0, []
        for cell, upper, lower in cells.walk(vector):
            if upper < floor:
                break  # no later cell reaches any window
            if not cells.may_hold(cell, bit, same) or not ((upper >= lows) & (lower <= highs)).any():
                continue
            out.append(cell)
            held += int(cells.counts[cell])
            if first and held >= FIRST:
                break
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = part.to_pydict()
                vectors = _padded(rows["vector"], cells.dims)
                found = [chosen(v, b, lo, hi) for v, b, lo, hi in zip(vectors, rows["bit"], rows["lows"], rows["highs"], strict=True)]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                if len(at):
                    own = part.select(names).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(f, np.int32) for f in found])), *own.columns], ["cell", *names])

    return askers.select(*names, _label_bit(F.col("label")).alias("bit")).mapInArrow(task, f"cell int, {_ASKER}")


_FOUND = "asker long, asker_id long, window int, score long, id long, row long"


def scored(asked: DataFrame, index: DataFrame, cells: Cells, same: bool, k: int) -> DataFrame:
    """The first k rows in each window of each asker, of every part of a cell it was sent to."""
    sizes = asked.groupBy("cell").agg(F.count("*").alias("n"))
    sizes = sizes.select("cell", F.ceil(F.col("n") / ASKERS).alias("groups"))
    counts = asked.sparkSession.createDataFrame([(i, -(-int(n) // PART)) for i, n in enumerate(cells.counts.tolist()) if n], "cell int, parts long")
    plan = sizes.join(F.broadcast(counts), "cell")  # a row for each cell
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = asked.join(F.broadcast(plan), "cell").withColumn("group", F.pmod(F.xxhash64("asker"), F.col("groups"))).withColumn("part", every("parts")).drop("groups", "parts")
    right = index.join(F.broadcast(plan), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).withColumn("group", every("groups")).drop("groups", "parts")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def meet(askers: pa.Table, rows: pa.Table) -> pa.Table:
        own = _padded(askers["vector"].to_pylist(), cells.dims)
        theirs = _padded(rows["vector"].to_pylist(), cells.dims)
        largest = float(np.abs(own).max(initial=0)) * float(np.abs(theirs).max(initial=0)) * cells.dims
        exact = np.float64 if largest < 2**53 else np.int64 if largest < 2**62 else object
        ids, keys, labels = (rows[c].to_numpy() for c in ("id", "row", "label"))
        theirs = theirs.astype(exact).T
        found = []
        columns = [askers[c].to_pylist() for c in ("asker", "asker_id", "label", "lows", "highs")]
        for vector, asker, asker_id, label, lows, highs in zip(own.astype(exact), *columns, strict=True):
            scores = vector @ theirs
            may = ((labels == label) if same else (labels != label)) & (keys != asker)
            for window, (low, high) in enumerate(zip(lows, highs, strict=True)):
                at = np.flatnonzero(may & (scores >= low) & (scores <= high))
                if len(at) > k and exact is not object:
                    at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
                best = sorted((-int(scores[r]), int(ids[r]), int(keys[r])) for r in at.tolist())[:k]
                found += [(asker, asker_id, window, -s, i, r) for s, i, r in best]
        return pa.table([pa.array([f[c] for f in found], t) for c, t in enumerate(kinds)], names)

    key = ["cell", "part", "group"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asker", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(askers: DataFrame, index: DataFrame, cells: Cells, same: bool, k: int) -> DataFrame:
    """asker, asker_id, window, rank, score, id, row: the first k rows of the same label (or of others) in each window of
    each asker (asker, asker_id, label, vector, lows, highs); higher scores first, ties to smaller ids."""
    first = written(scored(routes(askers, cells, same, True), index, cells, same, k), "multi-first")
    floors = _ranked(first, k).where(F.col("rank") == k).groupBy("asker").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floors"))
    known = askers.join(floors.withColumnRenamed("asker", "own"), F.col("asker") == F.col("own"), "left")
    raised = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("floors", w.cast("int")), low)))
    # the second walk takes the first cells again, so that its answer stands alone
    left = known.select("asker", "asker_id", "label", "vector", raised.alias("lows"), "highs")
    return _ranked(scored(routes(left, cells, same, False), index, cells, same, k), k)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", step: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, of anchors whose id is divisible by the step.

    A negative of a positive scores from ``low`` to ``high`` hundredths of it."""
    named = vectors.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vector"))
    rows = integer_vectors(named, "id", "vector", SCALE, keep=("label",))
    index, cells = build(rows)
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if cells is None:
        return spark.createDataFrame([], out)
    anchors = index.where(F.col("id") % step == 0).select(F.col("row").alias("asker"), F.col("id").alias("asker_id"), "label", "vector")
    everything = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("lows", LOW), ("highs", HIGH))]
    near = written(search(anchors.select("*", *everything), index, cells, True, positives), "multi-positives")
    wide = near.where("score >= 0").groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("near"))  # at most ``positives`` of them
    floor = F.transform("near", lambda p: _whole(p["score"], low, True))
    ceiling = F.transform("near", lambda p: _whole(p["score"], high, False))
    asking = anchors.join(wide, "asker").select("asker", "asker_id", "label", "vector", floor.alias("lows"), ceiling.alias("highs"))
    far = search(asking, index, cells, False, negatives)
    pairs = near.select("asker", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = far.select("asker", "window", F.col("asker_id").alias("anchor_id"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    met = met.join(pairs, ["asker", "window"])
    return met.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _whole(score: Column, percent: int, up: bool) -> Column:
    """score * percent / 100 in integers, rounded up or down."""
    product = score * F.lit(percent)
    rest = F.pmod(product, F.lit(100))
    down = F.call_function("div", product - rest, F.lit(100).cast("long"))
    return down + F.when(rest > 0, 1).otherwise(0) if up else down
