"""Repeated passages: bytes covered by a 50-byte string that also starts in a document with a smaller id.

1. Each 50-byte window is owned by its smallest 24-byte hash, its anchor; windows in a row with one anchor form a range
   of at most 32, whose context is all bytes they cover. Equal windows have equal anchors, so a window can only repeat
   inside one anchor. Ranges go, packed per chunk of text, to the bucket of their anchor. Copies inside a chunk are
   settled before that, so a passage that very many documents share reaches a bucket once for each chunk.
2. A bucket knows the smallest document of each context. Ranges of later documents are repeats as a whole. A range that is
   the first of its context while its anchor has other contexts is open: part of it may repeat elsewhere.
3. Open ranges (few: the edges of copies) go by anchor to cells. There the contexts of smaller documents are indexed as
   run-length compressed Burrows-Wheeler transforms with sampled run ends, the contexts of larger documents stream
   through as matching statistics, and every match of 50 bytes or more is marked. Documents of an anchor are halved by
   their order again and again, so each pair of documents meets once with the smaller one in the index.
4. An anchor with very many contexts would make a hot cell. Its open ranges are cut into single windows instead, and
   these go through step 1 and 2 again, dealt by their own hash: equal windows collapse per chunk, others spread.

Everything is judged on the input texts. Bytes are compared by 80 bits of hashes in step 2 and by themselves in step 3.

Defined results: a null text is empty; texts below 50 bytes are kept whole; rows that share an id never match each other;
rows with a null id lose nothing and cause nothing to be lost; repeated rows give equal rows. Long texts are cut into
overlapping segments, so memory in a task does not depend on them; the last step holds one text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoloom.llm.run_index import RunIndex
from memoloom.llm.storage import cut_small, dropped, written

LENGTH = 50
ANCHOR = 24
#: Windows of one range at most (five bits), bytes of a segment and of a chunk.
RANGE = 32
SEGMENT = 1 << 19
#: Contexts of an anchor that share a cell; more are cut into windows.
CELL_CONTEXTS = 32
CELLS_PER_PARTITION = 8

_WHOLE, _OPEN, _HOT = 1, 2, 3
#: A mark is a range: its first window and how many, in one number; an open one has its anchor and status too.
_OPEN_MARK = np.dtype([("range", "<i8"), ("anchor", "<u4"), ("status", "u1")])
#: What a packet says of each of its documents: id, tag, number of the segment, number of ranges.
_DOC = np.dtype([("id", "<i8"), ("tag", "<u4"), ("segment", "<u2"), ("n", "<u2")])
_POWER = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> np.ndarray:
    out = np.full(2 * SEGMENT + 1, np.uint64(_POWER))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    out = values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(out) - (width - have)], out[width - have :])


class Chunk:
    """Segments of some texts, one after the other, with the hashes of all their windows."""

    def __init__(self, segments: list[tuple[int, int, int, bytes]], powers: np.ndarray):
        self.ids = np.array([s[0] for s in segments], np.int64)
        self.keys = np.array([s[1] for s in segments], np.int64)
        self.bases = np.array([s[2] for s in segments], np.int64)
        self.text = b"".join(s[3] for s in segments)
        sizes = np.array([len(s[3]) for s in segments], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(self.text, np.uint8)
        letters = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_POWER))[data]
        self.powers = powers
        self.sums = np.r_[np.uint64(0), np.cumsum(letters * powers[: len(data)], dtype=np.uint64)]
        windows = np.maximum(sizes - (LENGTH - 1), 0)
        first = np.cumsum(windows) - windows
        self.owner = np.repeat(np.arange(len(segments)), windows)
        self.start = np.arange(len(self.owner)) - first[self.owner] + self.begins[self.owner]
        if len(self.start):
            gram = self._hash(np.arange(len(data) - ANCHOR + 1), ANCHOR)
            self.anchor = _sliding_min(gram, LENGTH - ANCHOR + 1)[self.start]
        else:
            self.anchor = np.zeros(0, np.uint64)

    def _hash(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hash of the bytes from each start on; the same wherever they stand."""
        return _mixed((self.sums[start + size] - self.sums[start]) * self.powers[len(self.powers) - 1 - start])

    def ranges(self) -> tuple[np.ndarray, ...]:
        """owner, start in the chunk, windows, anchor and context hash of every range."""
        owner, anchor = self.owner, self.anchor
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])] if len(owner) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        place = np.arange(len(owner)) - np.repeat(heads, np.diff(np.r_[heads, len(owner)]))
        heads = np.flatnonzero(place % RANGE == 0)
        n = np.diff(np.r_[heads, len(owner)])
        start = self.start[heads]
        return owner[heads], start, n, anchor[heads], self._hash(start, n + (LENGTH - 1))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[pa.RecordBatch]]]:
    """Segments (id, key, base, bytes) of up to about ``SEGMENT`` bytes, from rows (doc_id, text_key, text)."""
    held, size = [], 0
    for batch in cut_small(batches):
        for i in range(batch.num_rows):
            data = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
            for base in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
                part = data[base : base + SEGMENT + LENGTH - 1]
                if size + len(part) > 2 * SEGMENT:
                    yield held
                    held, size = [], 0
                held.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), base, part))
                size += len(part)
                if size >= SEGMENT:
                    yield held
                    held, size = [], 0
    if held:
        yield held


_PACKET = "bucket long, anchors binary, contexts binary, places binary, docs binary, doc_id long, text_key long, marks binary"
_PACKET_NAMES = ["bucket", "anchors", "contexts", "places", "docs", "doc_id", "text_key", "marks"]
_PACKET_KINDS = [pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.binary()]
_MARKED = "doc_id long, text_key long, marks binary, open boolean"
_MARKED_NAMES = ["doc_id", "text_key", "marks", "open"]
_MARKED_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.bool_()]


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names)


def _marked_rows(ids, keys, marks: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One (id, key, marks) for each document among parallel arrays."""
    if not len(ids):
        return []
    order = np.lexsort((keys, ids))
    ids, keys, marks = ids[order], keys[order], marks[order]
    heads = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
    ends = np.r_[heads[1:], len(ids)]
    return [(int(ids[a]), int(keys[a]), marks[a:b].tobytes()) for a, b in zip(heads.tolist(), ends.tolist(), strict=True)]


def _range(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 5 | (n.astype(np.int64) - 1)


def _packets(chunk: Chunk, owner, start, n, anchor, context, route, buckets: int) -> Iterator[tuple]:
    """Settle copies inside the chunk, and pack the rest by bucket."""
    ids = chunk.ids[owner]
    order = np.lexsort((ids, context))
    new = np.r_[True, context[order][1:] != context[order][:-1]] if len(order) else np.zeros(0, bool)
    least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else ids
    later = np.zeros(len(ids), bool)
    later[order] = ids[order] > least
    place = start - chunk.begins[owner]
    bucket = (route % np.uint64(buckets)).astype(np.int64)
    settled = np.flatnonzero(later)
    marks = _range((place + chunk.bases[owner])[settled], n[settled])
    for row in _marked_rows(ids[settled], chunk.keys[owner][settled], marks):
        yield (row[0] % buckets, None, None, None, None, *row)
    sent = np.flatnonzero(~later)
    sent = sent[np.lexsort((owner[sent], bucket[sent]))]
    heads = np.flatnonzero(np.r_[True, bucket[sent][1:] != bucket[sent][:-1]]) if len(sent) else np.zeros(0, int)
    short = (anchor >> np.uint64(32)).astype("<u4")
    digest = context.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    places = _range(place + (chunk.bases % SEGMENT)[owner], n).astype("<u4")
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(sent)], strict=True):
        part = sent[a:b]
        who, counts = np.unique(owner[part], return_counts=True)
        docs = np.zeros(len(who), _DOC)
        docs["id"], docs["tag"], docs["segment"], docs["n"] = chunk.ids[who], chunk.keys[who], chunk.bases[who] // SEGMENT, counts
        yield (int(bucket[part[0]]), short[part].tobytes(), digest[part].tobytes(), places[part].tobytes(), docs.tobytes(), None, None, None)


def _send(buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        for segments in _chunks(batches):
            chunk = Chunk(segments, powers)
            owner, start, n, anchor, context = chunk.ranges()
            rows = list(_packets(chunk, owner, start, n, anchor, context, anchor, buckets))
            if rows:
                yield _batch(rows, _PACKET_NAMES, _PACKET_KINDS)

    return task


def _settle(single: bool):
    """Over packets sorted by bucket: marks of every document, with what is open or hot unless ranges are single windows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        packets: list[dict] = []
        open_bucket = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != open_bucket:
                    out += judged(packets)
                    packets, open_bucket = [], row["bucket"]
                if row["marks"] is not None:
                    out.append((row["doc_id"], row["text_key"], row["marks"], False))
                else:
                    packets.append(row)
                if len(out) > 4096:
                    yield _batch(out, _MARKED_NAMES, _MARKED_KINDS)
                    out = []
        out += judged(packets)
        if out:
            yield _batch(out, _MARKED_NAMES, _MARKED_KINDS)

    def judged(packets: list[dict]) -> list[tuple]:
        if not packets:
            return []
        gather = lambda name, kind: np.concatenate([np.frombuffer(p[name], kind) for p in packets])
        anchors, places, docs = gather("anchors", "<u4"), gather("places", "<u4"), gather("docs", _DOC)
        digest = np.zeros((len(anchors), 8), np.uint8)
        digest[:, 2:] = gather("contexts", np.uint8).reshape(-1, 6)
        contexts = digest.view("<u8")[:, 0]
        owner = np.repeat(np.arange(len(docs)), docs["n"])
        ids = docs["id"][owner]
        order = np.lexsort((ids, contexts, anchors))
        new_anchor = np.r_[True, anchors[order][1:] != anchors[order][:-1]]
        new = new_anchor | np.r_[True, contexts[order][1:] != contexts[order][:-1]]
        least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        group = np.cumsum(new_anchor) - 1
        contexts_of = np.bincount(group[new], minlength=group[-1] + 1)[group]
        status = np.zeros(len(order), np.uint8)
        if not single:
            status[contexts_of > 1] = _OPEN
            status[contexts_of > CELL_CONTEXTS] = _HOT
        status[ids[order] > least] = _WHOLE
        rows = []
        for open_ in (False, True):
            chosen = np.flatnonzero((status > _WHOLE) if open_ else (status == _WHOLE))
            at = order[chosen]
            base = docs["segment"][owner[at]].astype(np.int64) * SEGMENT
            marks = places[at].astype(np.int64) + (base << 5)
            if open_:
                whole = np.zeros(len(at), _OPEN_MARK)
                whole["range"], whole["anchor"], whole["status"] = marks, anchors[at], status[chosen]
                marks = whole
            rows += [(*row, open_) for row in _marked_rows(ids[at], docs["tag"][owner[at]], marks)]
        return rows

    return task


_CELL = "cell long, anchor long, doc_id long, text_key long, start long, context binary"
_CELL_NAMES = ["cell", "anchor", "doc_id", "text_key", "start", "context"]


def _reopen(buckets: int, cell_count: int):
    """Over (doc_id, text_key, packed text, marks): cells rows of open ranges, packets of the windows of hot ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        unpack = zstandard.ZstdDecompressor().decompress
        kinds = [pa.int64()] * 5 + [pa.binary()]
        cells, hot, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, key, packed, marks = (batch.column(c)[i].as_py() for c in range(4))
                data = unpack(packed)
                for place, anchor, status in np.frombuffer(b"".join(marks), _OPEN_MARK).tolist():
                    start = place >> 5
                    context = data[start : start + (place & 31) + LENGTH]
                    if status == _OPEN:
                        cells.append((anchor % cell_count, anchor, doc_id, key, start, context))
                    else:
                        hot.append((doc_id, key, start, context))
                        size += len(context)
                    if size >= SEGMENT:
                        yield windows(hot, powers)
                        hot, size = [], 0
                if len(cells) >= 10_000:
                    yield both(_batch(cells, _CELL_NAMES, kinds), None)
                    cells = []
        if cells:
            yield both(_batch(cells, _CELL_NAMES, kinds), None)
        if hot:
            yield windows(hot, powers)

    def windows(hot: list[tuple], powers: np.ndarray) -> pa.RecordBatch:
        chunk = Chunk(hot, powers)
        n = np.ones(len(chunk.start), np.int64)
        context = chunk._hash(chunk.start, LENGTH)
        rows = list(_packets(chunk, chunk.owner, chunk.start, n, chunk.anchor, context, context >> np.uint64(7), buckets))
        return both(None, _batch(rows, _PACKET_NAMES, _PACKET_KINDS))

    def both(cells: pa.RecordBatch | None, packets: pa.RecordBatch | None) -> pa.RecordBatch:
        size = (cells if cells is not None else packets).num_rows
        columns, names = [], []
        for batch, own, kinds, prefix in (
            (cells, _CELL_NAMES, [pa.int64()] * 5 + [pa.binary()], "c_"),
            (packets, _PACKET_NAMES, _PACKET_KINDS, "p_"),
        ):
            for name, kind in zip(own, kinds, strict=True):
                columns.append(batch.column(name) if batch is not None else pa.nulls(size, kind))
                names.append(prefix + name)
        return pa.RecordBatch.from_arrays(columns, names)

    return task


def _prefixed(schema: str, prefix: str) -> str:
    return ", ".join(prefix + field for field in schema.split(", "))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over cell rows sorted by cell: marks of the windows that an earlier document of their anchor has too."""
    rows: list[tuple] = []
    open_cell = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in _CELL_NAMES]
        for row in zip(*columns, strict=True):
            if row[0] != open_cell:
                if rows:
                    yield from _in_cell(rows)
                rows, open_cell = [], row[0]
            rows.append(row)
    if rows:
        yield from _in_cell(rows)


def _in_cell(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    _, anchors, ids, keys, starts, contexts = (list(c) for c in zip(*rows, strict=True))
    anchors, ids = np.array(anchors, np.int64), np.array(ids, np.int64)
    order = np.lexsort((ids, anchors))
    new_anchor = np.r_[True, anchors[order][1:] != anchors[order][:-1]]
    new_doc = np.r_[True, ids[order][1:] != ids[order][:-1]] & ~new_anchor
    group = np.cumsum(new_anchor) - 1
    steps = np.cumsum(new_doc)
    heads = np.flatnonzero(new_anchor)
    rank = np.empty(len(order), np.int64)
    rank[order] = steps - steps[heads][group]
    last = np.empty(len(order), np.int64)  # largest rank of the row's anchor
    last[order] = np.maximum.reduceat(rank[order], heads)[group]
    found: dict[int, np.ndarray] = {}
    level = 0
    while (1 << level) <= int(last.max()):
        for half in range((int(last.max()) >> (level + 1)) + 1):
            middle = (half << (level + 1)) + (1 << level)
            mine = (rank >> (level + 1) == half) & (last >= middle)
            earlier, later = np.flatnonzero(mine & (rank < middle)), np.flatnonzero(mine & (rank >= middle))
            if not len(later):
                continue
            texts = list(dict.fromkeys(contexts[i] for i in earlier.tolist()))
            lengths, ends = RunIndex(texts).matches([contexts[i] for i in later.tolist()])
            begin = 0
            for i, end in zip(later.tolist(), ends.tolist(), strict=True):
                hit = lengths[begin : end - LENGTH + 1] >= LENGTH
                begin = end + 1
                if hit.any():
                    found[i] = found[i] | hit if i in found else hit
        level += 1
    out = []
    for i, hit in found.items():
        edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
        first, n = edges[::2], edges[1::2] - edges[::2]
        out.append((int(ids[i]), keys[i], _range(starts[i] + first, n).tobytes(), False))
    if out:
        yield _batch(out, _MARKED_NAMES, _MARKED_KINDS)


def text_key(text: Column) -> Column:
    """32 bits that tell texts apart which share an id."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(0xFFFFFFFF)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text); the key tells texts apart that share an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))


def _packed(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, packed) and any further columns: texts as compressed bytes, to be sent to other tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in cut_small(batches):
            packed = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            columns = [*batch.columns[:2], pa.array(packed, pa.binary()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "packed", *batch.schema.names[3:]])

    others = [f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[3:]]
    return rows.mapInArrow(pack, "doc_id long, text_key long, packed binary" + "".join(others))


def _settled(packets: DataFrame, single: bool) -> DataFrame:
    buckets = _partitions(packets)
    return packets.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(_settle(single), _MARKED)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, marks): the ranges of windows that a smaller document has too, in packed form, as a written table; what
    led to them goes."""
    buckets = _partitions(docs)
    rows = _keyed(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    # texts as they are: packed ones would take a second Python worker to each task, and workers live on with what they hold
    first = written(_settled(rows.mapInArrow(_send(buckets), _PACKET), False), "repeats-first")
    waiting = first.where("open").groupBy("doc_id", "text_key").agg(F.collect_list("marks").alias("marks"))
    joined = _packed(rows).join(waiting, ["doc_id", "text_key"])
    schema = f"{_prefixed(_CELL, 'c_')}, {_prefixed(_PACKET, 'p_')}"
    opened = written(joined.mapInArrow(_reopen(buckets, CELLS_PER_PARTITION * buckets), schema), "repeats-open")
    cells = opened.where("c_cell is not null").select(*[F.col(f"c_{c}").alias(c) for c in _CELL_NAMES])
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    windows = opened.where("p_bucket is not null").select(*[F.col(f"p_{c}").alias(c) for c in _PACKET_NAMES])
    found = first.where("not open").union(_settled(windows, True)).union(cells.mapInArrow(_matched, _MARKED))
    marks = written(found.select("doc_id", "text_key", "marks"), "repeats-marks")
    dropped(first)
    dropped(opened)
    return marks


def _cut(whole: bool):
    """Over (doc_id, text_key, packed, marks, any others): counts, digest and on demand the text that is left and the others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in cut_small(batches):
            out = []
            for doc_id, key, packed, marks in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                data = b"" if packed is None else unpack(packed)
                gone = removed(len(data), marks or [])
                left = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
                row = (doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
                out.append((*row, key, None if packed is None else characters(data, gone)) if whole else row)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64(), pa.string()] * whole
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text_key", "kept_text"] * whole
            cut = _batch(out, names, kinds)
            yield pa.RecordBatch.from_arrays([*cut.columns, *batch.columns[4:]], [*names, *batch.schema.names[4:]])

    def removed(size: int, packed: list[bytes]) -> np.ndarray:
        marks = np.frombuffer(b"".join(packed), "<i8")
        start, n = marks >> 5, (marks & 31) + 1
        change = np.zeros(size + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + n + LENGTH - 1, -1)
        return np.cumsum(change[:size]) > 0

    def characters(data: bytes, gone: np.ndarray) -> str:
        """What is left in whole characters: one stays if any of its bytes stays."""
        if not gone.any():
            return data.decode("utf-8", "replace")
        raw = np.frombuffer(data, np.uint8)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        lost = np.logical_and.reduceat(gone, heads)
        return raw[~np.repeat(lost, np.diff(np.r_[heads, len(raw)]))].tobytes().decode("utf-8", "replace")

    return task


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, others: Sequence[str] = ()
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; on demand text_key and kept_text (null if the text is),
    and other columns of the row as the fields of one, others."""
    marks = repeated_ranges(docs, id_col, text_col).groupBy("doc_id", "text_key").agg(F.collect_list("marks").alias("marks"))
    further = [F.struct(*others).alias("others")] if others else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"), *further)
    names = ["others"] if others else []
    sent = _packed(rows).join(marks, ["doc_id", "text_key"], "left").select("doc_id", "text_key", "packed", "marks", *names)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text_key long, kept_text string" * with_text
    return sent.mapInArrow(_cut(with_text), schema + "".join(f", {n} {sent.schema[n].dataType.simpleString()}" for n in names))
