"""SimHash near-duplicates: fingerprints that differ in few bits, found by Gray-order hierarchical indexes.

Fingerprints within three bits agree on one of four 16-bit blocks. Each distinct fingerprint is therefore dealt four
times, rotated so that the block leads, and the four orders by Gray rank are range partitioned: equal leading blocks form
a run, and a run is a group of the index. Range bounds follow the data, so a block that very many fingerprints share
spreads over many tasks. A task indexes its runs in chunks of bounded size and links inside them.

A run cut into chunks is finished in a second round. By then its members mostly share one component; only members outside
the run's largest component are sent to the run's other chunks. What comes out of a task is a spanning forest or pairs of
components, never all pairs of a group. Components are then contracted over all links.

Defined results: a null or wordless text has fingerprint zero and links like any other; equal fingerprints link; every
input row gives a row, repeated rows included. A row with a null id takes its component from rows that have one, or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoloom.llm.components import components
from memoloom.llm.gray_index import Forest, GrayIndex, gray_rank, gray_value
from memoloom.llm.storage import cut_small
from memoloom.workspace import materialized

#: Members of one chunk of a run: bounds the memory and the work of one index.
CHUNK = 2048
#: Leaves indexed together; many short runs share one index.
BATCH = 1 << 15
BLOCKS = 4
_TOP = np.uint64(1 << 63)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 values of the word shingles of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        starts = np.r_[0, ends[:-1] + 1][: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def with_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits in a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_small(batches):
            prints = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(digest, "doc_id long, fp long")


def _rotated(values: np.ndarray, bits: int) -> np.ndarray:
    return values if bits == 0 else (values << np.uint64(bits)) | (values >> np.uint64(64 - bits))


def _orders(distinct: DataFrame) -> DataFrame:
    """(block, rank, node): every fingerprint once for each block, ranked with that block in front."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for block in range(BLOCKS):
                rank = (gray_rank(_rotated(prints, 64 // BLOCKS * block)) ^ _TOP).view(np.int64)
                kind = np.full(len(prints), block, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(rank), batch.column(1)], ["block", "rank", "node"])

    return distinct.mapInArrow(deal, "block int, rank long, node long")


_LINKS = "run long, chunk long, a long, b long"


def _linked(distance: int):
    """Over rows in (block, rank) order: links inside chunks as (null, null, member, root), and the members of every
    run that may go on in another chunk as (run, chunk, member, rank)."""

    def rows(run, chunk, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (run, chunk, a, b)], ["run", "chunk", "a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        chunks, first, held = 0, True, None
        for block in _in_batches(batches):
            if held is not None:
                block = np.concatenate([held, block])
            head = block[:BATCH] if len(block) > BATCH else block
            held = block[len(head) :]
            yield from work(head, part + chunks, first, False)
            chunks, first = chunks + len(head), False
        if held is not None and len(held):
            yield from work(held, part + chunks, first, True)

    def work(table: np.ndarray, base: int, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        ranks = table[:, 1].view(np.uint64) ^ _TOP
        run = (table[:, 0] << 16) | (ranks >> np.uint64(64 - 64 // BLOCKS)).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        sizes = np.diff(np.r_[heads, len(run)])
        place = np.arange(len(run)) - np.repeat(heads, sizes)
        chunk = base + np.repeat(heads, sizes) + place // CHUNK  # unique, as a run has more rows than chunks
        index = GrayIndex(gray_value(ranks), chunk)
        forest = Forest(len(run))
        for i, j in index.links(index, distance):
            forest.link(i, j)
        member = np.flatnonzero(forest.label != np.arange(len(run)))
        nodes, none = table[:, 2], np.full(len(member), None)
        if len(member):
            yield rows(none, none, nodes[member], nodes[forest.label[member]])
        cut = np.repeat(sizes > CHUNK, sizes) | (run == run[0]) | (run == run[-1])
        if cut.any():
            yield rows(run[cut], chunk[cut], nodes[cut], table[cut, 1])

    return task


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows as (n, columns) arrays of longs, each at most BATCH long."""
    for batch in batches:
        if batch.num_rows:
            table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            for start in range(0, len(table), BATCH):
                yield table[start : start + BATCH]


def _met(distance: int):
    """Over rows sorted by (chunk, visiting): pairs of components of visitors and members within the distance."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[np.ndarray] = []
        open_chunk = None
        for table in _in_batches(batches):
            for start, end in _runs(table[:, 0]):
                if table[start, 0] != open_chunk:
                    open_chunk, members = table[start, 0], []
                part = table[start:end]
                members.append(part[part[:, 1] == 0])
                visitors = part[part[:, 1] == 1]
                if len(visitors):
                    own = np.concatenate(members)
                    members = [own]
                    for k in range(0, len(visitors), CHUNK):
                        if len(pairs := compare(own, visitors[k : k + CHUNK])):
                            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def compare(own: np.ndarray, visitors: np.ndarray) -> np.ndarray:
        sides = []
        for rows in (own, visitors):
            rows = rows[np.argsort(rows[:, 2])]
            sides.append((GrayIndex(gray_value(rows[:, 2].view(np.uint64) ^ _TOP), np.zeros(len(rows), np.int64)), rows))
        (left, mine), (right, theirs) = sides
        height = max(len(left.levels), len(right.levels))
        found = []
        for i, j in left.aligned(height).links(right.aligned(height), distance):
            pairs = np.stack([mine[i, 3], theirs[j, 3]], axis=1)
            found.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    return task


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    yield from zip(heads.tolist(), np.r_[heads[1:], len(keys)].tolist(), strict=True)


def link_fingerprints(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(node, component) of every node whose fingerprint (fp, node) links to another one."""
    if not 0 <= distance < BLOCKS:
        raise ValueError(f"distance must be below {BLOCKS}")
    order = _orders(distinct).repartitionByRange("block", "rank").sortWithinPartitions("block", "rank")
    found = materialized(order.mapInArrow(_linked(distance), _LINKS), "simhash-links")
    first = materialized(components(found.where("run is null").select("a", "b")), "simhash-components")
    left = _left_over(found.where("run is not null"), first)
    cells = left.repartition("chunk").sortWithinPartitions("chunk", "visiting")
    more = materialized(cells.mapInArrow(_met(distance), "a long, b long"), "simhash-met")
    if more.isEmpty():
        return first
    joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    nodes = first.union(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")))
    nodes = nodes.groupBy("node").agg(F.min("component").alias("component"))
    return nodes.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def _left_over(cut: DataFrame, first: DataFrame) -> DataFrame:
    """(chunk, visiting, rank, component): members of runs in several chunks, and visitors from outside the run's
    largest component."""
    known = first.select(F.col("node").alias("a"), "component")
    members = cut.join(known, "a", "left").select("run", "chunk", F.col("b").alias("rank"), F.coalesce("component", "a").alias("component"))
    members = materialized(members, "simhash-cut")
    sizes = members.groupBy("run", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("run").agg(F.max(F.struct("n", "component")).alias("most"))
    chunks = members.select("run", "chunk").distinct()
    wide = chunks.groupBy("run").agg(F.count("*").alias("chunks")).where("chunks > 1").select("run")
    largest = largest.join(wide, "run").select("run", F.col("most.component").alias("main"))
    outside = members.join(largest, "run").where("component <> main").select("run", F.col("chunk").alias("home"), "rank", "component")
    visitors = outside.join(chunks, "run").where("chunk <> home")
    hosts = visitors.select("chunk").distinct()
    own = members.join(hosts, "chunk", "left_semi")
    return own.select("chunk", F.lit(0).alias("visiting"), "rank", "component").union(
        visitors.select("chunk", F.lit(1).alias("visiting"), "rank", "component")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links) of every row."""
    prints = materialized(with_fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    named = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    distinct = materialized(named, "simhash-distinct")
    linked = link_fingerprints(distinct, distance)
    classes = distinct.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(classes, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
