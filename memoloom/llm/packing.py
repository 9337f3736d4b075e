"""Best-fit packing of token pieces into sequences of one length.

Only the histogram of piece lengths decides how sequences are filled: a configuration says how many pieces of each length
share a sequence. The covering linear program over configurations (fewest sequences that hold all pieces) is solved by
multiplicative weights: every length has a price that falls as it gets covered, a knapsack by dynamic programming finds
the configuration worth most at these prices, and that one is used for a while. The fractional solution is rounded down
to whole sequences, and what is left is filled best-fit, from the longest piece down.

The driver sees the histogram alone (one row per length, at most the capacity). Its answer, the runs, has at most
``ROUNDS`` x ``COLUMNS`` + capacity configurations of at most 63 lengths each, whatever the corpus. Pieces find their place by their rank
among pieces of their length: ranks inside a written partition, plus how many the partitions before it hold. No length,
however frequent, is gathered in one task.

Defined results: a null text is empty and has its closing id only; rows with a null id are packed like others; rows that
share an id are pieces of their own; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memoloom.llm.tokens import GENERATION, VOCABULARY, encoded
from memoloom.workspace import materialized

CAPACITY = 2048
#: Rounds of the weights, configurations priced in each, how fast a price falls with coverage, and how much of the
#: scarcest length of a configuration one round covers.
ROUNDS = 300
COLUMNS = 24
RATE = 1.0
STEP = 0.5
#: Shares of the fractional solution that rounding tries; the rest of the pieces completes sequences best-fit. With share 0
#: that is all pieces, so no answer needs more sequences than filling best-fit alone.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.3, 0.15, 0.0)


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    end_id: int = 0,
    with_ids: bool = False,
    remembered: int = GENERATION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document cut at the capacity, and the ids on demand; part and
    rank_in_part number the pieces of one length inside a task and hold once the frame is written."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch, found in encoded(batches, vocabulary, 1, remembered):
            out: list[tuple] = []
            ids = []
            for name, data in zip(batch.column(0).to_pylist(), found, strict=True):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    length = len(own) // 4
                    out.append((name, piece, at // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").tolist())
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"
    return rows.mapInArrow(cut, schema + ", ids array<long>" * with_ids)


def best_configurations(lengths: np.ndarray, prices: np.ndarray, capacity: int, many: int) -> list[dict[int, int]]:
    """The unbounded knapsack by dynamic programming, read back for the dearest lengths: for each of them the
    configuration of greatest price that holds it, as places in ``lengths`` (ascending) with how often each is taken."""
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    rooms = np.arange(capacity + 1)[:, None] - lengths  # what a piece leaves of a room
    for room in range(1, capacity + 1):
        n = fitting[room]
        value[room] = value[room - 1]
        if n:
            worth = value[rooms[room, :n]] + prices[:n]
            k = worth.argmax()
            if worth[k] > value[room]:
                value[room], taken[room] = worth[k], k
    total = value[capacity - lengths] + prices
    out = []
    for first in np.argsort(-np.where(prices > 0, total, -np.inf))[:many].tolist():
        chosen = {first: 1}
        room = capacity - int(lengths[first])
        while room > 0:
            k = int(taken[room])
            if k < 0:
                room -= 1
            else:
                chosen[k] = chosen.get(k, 0) + 1
                room -= int(lengths[k])
        out.append(chosen)
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Configurations with fractional numbers of sequences that together hold the counts, by multiplicative weights."""
    demand = counts.astype(float)
    dear = 0.5 * (lengths / capacity + 1 / (capacity // lengths))  # pieces that leave no room for their like start dearer
    covered = np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        open_ = covered < 1 - 1e-9
        if not open_.any():
            break
        prices = np.where(open_, dear * np.exp(-RATE * (covered - covered[open_].min())), 0.0)
        for chosen in best_configurations(lengths, prices, capacity, COLUMNS):
            k, a = np.array(list(chosen)), np.array(list(chosen.values()))
            room = float(((1 - covered[k]) * demand[k] / a).min())
            share = min(room, max(1.0, STEP * float((demand[k] / a).min())))
            if share > 1e-9:
                covered[k] += a * share / demand[k]
                key = tuple(sorted(chosen.items()))
                used[key] = used.get(key, 0.0) + share
    return [(dict(key), share) for key, share in used.items()]


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length, number of sequences filled so) holding every piece of the histogram exactly once."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    solved = fractional(lengths, counts, capacity) if len(lengths) else []
    found = [_rounded(lengths, counts, capacity, solved, share) for share in SHARES]
    return min(found, key=lambda filled: sum(times for _, times in filled))


def _rounded(lengths, counts, capacity: int, solved, share: float) -> list[tuple[dict[int, int], int]]:
    """Whole sequences of a share of the fractional solution, as far as they are full, and the rest best-fit."""
    sizes, left = lengths.tolist(), counts.tolist()
    out = []

    def use(chosen: dict[int, int], times: int) -> None:
        for k, a in chosen.items():
            left[k] -= a * times
        out.append(({sizes[k]: a for k, a in chosen.items()}, times))

    for chosen, sequences in solved:
        times = min(int(sequences * share + 1e-6), *(left[k] // a for k, a in chosen.items()))
        if times > 0 and sum(sizes[k] * a for k, a in chosen.items()) == capacity:
            use(chosen, times)
    open_ = [k for k, n in enumerate(left) if n]
    open_sizes = [sizes[k] for k in open_]
    while open_:
        chosen, room, at = {}, capacity, len(open_)
        while (at := min(at, bisect_right(open_sizes, room)) - 1) >= 0:  # the longest piece that fits, as often as it fits
            k = open_[at]
            chosen[k] = min(room // sizes[k], left[k])
            room -= chosen[k] * sizes[k]
        use(chosen, min(left[k] // a for k, a in chosen.items()))
        for k in [k for k in chosen if not left[k]]:
            at = bisect_left(open_, k)
            del open_[at], open_sizes[at]
    return out


def runs(configured: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length rows of (first rank, first sequence, pieces per sequence, offset), ascending by rank."""
    ranks: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for chosen, times in configured:
        offset = 0
        for length, a in sorted(chosen.items(), reverse=True):
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, a, offset))
            ranks[length] = rank + a * times
            offset += a * length
        sequence += times
    return {length: np.array(found, np.int64) for length, found in rows.items()}


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to written pieces (length, part, rank_in_part and any other columns)."""
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = materialized(counts, "packing-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most a row per length
    places = runs(configurations({r["length"]: r["n"] for r in histogram}, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    kept = [c for c in cut.columns if c not in ("part", "rank_in_part")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for own in np.unique(length).tolist():
                mine = np.flatnonzero(length == own)
                table = places[own]
                first, base, each, shift = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1].T
                sequence[mine] = base + (rank[mine] - first) // each
                offset[mine] = shift + (rank[mine] - first) % each * own
            columns = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in kept)
    return ranked.select(*kept, "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = 0, **options) -> DataFrame:
    """Every piece of every document with the sequence it went to and its place there."""
    return assign(materialized(pieces(docs, capacity, vocabulary, end_id, **options), "packing-pieces"), capacity)
