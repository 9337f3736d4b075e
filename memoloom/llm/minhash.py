"""MinHash near-duplicates: banded candidates, verified by odd sketches, confirmed on full shingle sets.

Equal shingle sets are one node. A node's 512 MinHash samples are folded into a bitmap of 1,024 parities (its odd sketch):
two sketches differ in few bits exactly if few samples differ, so the population count of their XOR estimates a high
similarity with a standard error of about 0.025. 128 of the samples form 32 bands of 4; nodes that share a band meet in a bucket. A pair
at similarity 0.8 shares no band with a chance of 5e-8, and is refused by its sketches (estimate below 0.65) with one of
1e-7. All that pass are compared on their full sets, so there are no wrong links.

No bucket is written as pairs. A node is first compared with the smallest nodes of two of its buckets; what that links is
contracted. In buckets that still hold several components, the nodes outside the largest one are compared with all members,
in cells of bounded size: sketches first, then full sets inside the task, likeliest pairs first, and no pair that is joined
already. A cell gives links that join components and never all its pairs. Buckets with the same members are compared once.

Defined results: words are split at ASCII white space, ASCII letters in lower case; a text of one to ``words`` words has one
shingle, all of it. Null and wordless texts have no shingle and are linked with nothing (``empty_alike``: with each other). Every row
gives a row and is judged by its own text, repeated rows and ids included. A row with a null id takes its component from
rows that have one, or null; it is kept unless such a row exists. Texts of any length are used whole; other columns are not
read, whatever they are called. An empty table gives no rows. Shingles are compared by their XXH64 values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoloom.llm.components import components
from memoloom.llm.storage import cut_small, dropped, written

WORDS = 4
BANDS, BAND_ROWS = 32, 4
SAMPLES = 512
BITS = 1024
#: Estimated similarity below which a pair is not looked at further: five standard errors below 0.8.
LEAST = 0.65
#: Members and shingles of either side of a cell, and pairs of one hub in a task.
CELL = 2048
CELL_SHINGLES = 1 << 20
HUB = 4096

_SEEDS = np.array([xxhash.xxh64_intdigest(str(i), 11) for i in range(2 * SAMPLES)], np.uint64)
_FACTOR = (_SEEDS[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_SEEDS[SAMPLES:] >> np.uint64(32)).astype(np.uint32)
_PLACE = _SEEDS[:SAMPLES].astype(np.uint32) | np.uint32(1)


def shingles(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """XXH64 values of the distinct word shingles of one whole text, ascending."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64))


def samples(own: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each of the permutations."""
    low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    room = np.empty((min(len(low), 256), SAMPLES), np.uint32)
    for start in range(0, len(low), 256):
        part = low[start : start + 256, None]
        values = np.multiply(part, _FACTOR, out=room[: len(part)])
        values += _SHIFT
        np.minimum(least, values.min(axis=0), out=least)
    return least


def bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for every band of every row of samples."""
    parts = signatures[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for r in range(BAND_ROWS):
        out = (out ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out


def odd_sketches(signatures: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as rows of 64-bit words: sample i with its value toggles one bit."""
    place = ((signatures * _PLACE + _SHIFT) >> np.uint32(32 - 10)).astype(np.int64)
    place += np.arange(len(place))[:, None] * BITS
    odd = (np.bincount(place.ravel(), minlength=len(place) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, BITS), axis=1, bitorder="little").view("<u8")


def estimate(differing):
    """Similarity that sketches differing in so many bits stand for."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(differing) / BITS, 1e-9))


def most_differing(similarity: float) -> int:
    """Most differing bits of sketches whose estimate is not below the similarity."""
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


def _longs(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width), pa.int32()), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def _prints(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, key of the set, its size, bands and odd sketch, of rows (doc_id, text)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_small(batches):
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            signatures = np.array([samples(s) for s in sets], np.uint32).reshape(-1, SAMPLES)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [_longs(bands(signatures)), _longs(odd_sketches(signatures))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "bands", "sketch"])

    return rows.mapInArrow(digest, "doc_id long, key binary, n long, bands array<long>, sketch array<long>")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose odd sketches allow the similarity."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    differing = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return pairs.join(left, "a").join(right, "b").where(differing <= most_differing(LEAST)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets (node, shingles) have 100 * intersection >= percent * union.

    The set of a pair's first node is held, those of the second stream by; a node that is first in very many pairs is
    held by several tasks."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).alias("parts"))
    second = pairs.join(spread, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    second = second.join(sets, F.col("b") == F.col("node")).select("a", "part", "b", "shingles")
    hubs = spread.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    hubs = hubs.join(sets, F.col("a") == F.col("node")).select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
    rows = hubs.union(second).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in cut_small(batches, 512):
            firsts, seconds = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            ends = batch.column(3)
            found = []
            for i, (a, b) in enumerate(zip(firsts, seconds, strict=True)):
                values = ends[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                if b is None:
                    hub, own = a, values
                elif a == hub and _similar(own, values, percent):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def _cells(members: DataFrame, linked: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, i, j, outside, node, component, sketch, shingles): of every bucket with several components, the members outside
    its largest component against all its members, both cut into chunks of bounded size."""
    known = linked.withColumnRenamed("node", "known")
    labelled = members.join(known, F.col("node") == F.col("known"), "left").join(nodes.select(F.col("node").alias("own"), "n"), F.col("own") == F.col("node"))
    labelled = written(labelled.select("bucket", "node", "n", F.coalesce("component", "node").alias("component")), "minhash-labelled")
    sums = [F.count("*").alias("rows"), F.sum("n").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign")]
    parts = labelled.groupBy("bucket", "component").agg(*sums)
    sums = [F.sum(c).alias(c) for c in ("rows", "size", "sign")]
    open_ = parts.groupBy("bucket").agg(F.count("*").alias("components"), F.max(F.struct("rows", "size", "component")).alias("main"), *sums)
    open_ = open_.where("components > 1").groupBy("rows", "sign").agg(F.min(F.struct("bucket", "main", "size")).alias("o"))  # the same members are compared once
    chunks = lambda rows, size: F.greatest(F.ceil(rows / CELL), F.ceil(size / CELL_SHINGLES), F.lit(1))
    outer = chunks(F.col("rows") - F.col("o.main.rows"), F.col("o.size") - F.col("o.main.size"))
    open_ = open_.select("o.bucket", F.col("o.main.component").alias("main"), outer.alias("outer"), chunks(F.col("rows"), F.col("o.size")).alias("all"))
    at = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = labelled.join(open_, "bucket")
    outside = dealt.where("component <> main").select("bucket", at("outer").alias("i"), every("all").alias("j"), F.lit(True).alias("outside"), "node", "component")
    inside = dealt.select("bucket", every("outer").alias("i"), at("all").alias("j"), F.lit(False).alias("outside"), "node", "component")
    return outside.union(inside).join(nodes.select("node", "sketch"), "node").join(sets, "node").select(*_CELL)


_CELL = ["bucket", "i", "j", "outside", "node", "component", "sketch", "shingles"]


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets have 100 * intersection >= percent * union."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def links_of(outside: list, members: list, percent: int = 80) -> list[tuple[int, int]]:
    """Links that join components, of nodes (node, component, sketch, set) with members: likeliest pairs first, and none of
    nodes that are joined already."""
    if not outside or not members:
        return []
    most = most_differing(LEAST)
    labels = {c: k for k, c in enumerate({m[1] for m in members} | {m[1] for m in outside})}
    label = np.array([labels[m[1]] for m in members])
    sketch = np.array([m[2] for m in members], np.uint64)
    name = np.arange(len(labels))  # of every component, the one it was joined to
    found = []
    for node, component, own, values in outside:
        differing = np.bitwise_count(sketch ^ own).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero((differing <= most) & (name[label] != name[labels[component]]))
        for k in near[np.argsort(differing[near], kind="stable")].tolist():
            mine, theirs = name[labels[component]], name[label[k]]
            if mine != theirs and _similar(values, members[k][3], percent):
                name[name == theirs] = mine
                found.append((node, members[k][0]))
    return found


def across(cells: DataFrame) -> DataFrame:
    """Links (a, b) between different components of a cell; no more than the cell has components."""
    rows = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        key = None
        for batch in cut_small(batches, 512):
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            outside, nodes, components_ = (batch.column(c).to_pylist() for c in (3, 4, 5))
            for r, own in enumerate(keys):
                if own != key:
                    yield from emit(links_of(*sides))
                    sides, key = ([], []), own
                sketch, values = (batch.column(c)[r].values.to_numpy().view(np.uint64).copy() for c in (6, 7))
                sides[0 if outside[r] else 1].append((nodes[r], components_[r], sketch, values))
        yield from emit(links_of(*sides))

    def emit(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return rows.mapInArrow(meet, "a long, b long")


def classes(rows: DataFrame, words: int = WORDS, empty_alike: bool = False, proposed: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of rows (doc_id, text); ``proposed`` are pairs (a, b) of ids to be compared too."""
    prints = written(_prints(rows, words), "minhash-prints")
    owners = prints.where("doc_id is not null").groupBy("key")
    owners = owners.agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")])
    nodes = written(owners.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    dealt = written(nodes.where("n > 0").select("node", F.explode("bands").alias("bucket")), "minhash-buckets")
    heads = dealt.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last")
    members = written(dealt.join(heads.select("bucket", "head"), "bucket"), "minhash-members")
    stars = members.where("node <> head").groupBy("node").agg(F.min("head").alias("low"), F.max("head").alias("high"))
    stars = stars.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("a"), F.col("node").alias("b"))
    stars, met = _alike(stars, nodes), members.select("node")
    if proposed is not None:
        named = nodes.where("n > 0").select("first_id", "node")  # ids of nodes; pairs of other copies say nothing new
        ends = [named.toDF(c, n) for c, n in (("a", "x"), ("b", "y"))]
        more = written(proposed.join(ends[0], "a").join(ends[1], "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")), "minhash-proposed")
        stars, met = stars.union(more).distinct(), met.union(more.select(F.explode(F.array("a", "b"))))
    sets = _full_sets(rows, words, nodes, met)
    found = written(confirmed(stars, sets), "minhash-links")
    linked = written(components(found), "minhash-linked")
    more = written(across(_cells(members, linked, nodes, sets)), "minhash-across")
    if not more.isEmpty():
        linked = written(components(found.union(more)), "minhash-linked")
    for read in (sets, members, dealt):  # links are all that is left of them
        dropped(read)
    named = nodes.join(linked, "node", "left").select("key", "n", "first_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes_ = named.where(F.lit(empty_alike) | (F.col("n") > 0)).join(least, "component").select("key", "component_id")
    own = prints.select("doc_id", "key", "n").join(classes_, "key", "left")
    alone = F.when(F.lit(not empty_alike) & (F.col("n") == 0), F.col("doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", alone).alias("component_id"))


def _full_sets(rows: DataFrame, words: int, nodes: DataFrame, met: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes (node) that are to be compared, from one row of each."""
    met = nodes.join(met.distinct(), "node", "left_semi").select("node", "key", "first_id")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_small(batches, 64):
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "own", "shingles"])

    chosen = rows.join(met.select("first_id").distinct(), F.col("doc_id") == F.col("first_id"), "left_semi")
    sets = chosen.mapInArrow(digest, "doc_id long, own binary, shingles array<long>").dropDuplicates(["doc_id", "own"])
    sets = sets.join(met, (F.col("own") == F.col("key")) & (F.col("doc_id") == F.col("first_id")))
    return written(sets.select("node", "shingles"), "minhash-sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return classes(rows, words).withColumn("kept", kept)
