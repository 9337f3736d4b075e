"""Alignment of two tokenizers over whole texts: groups between common token ends, links of overlapping tokens.

Texts are encoded with a leading space. Where a token of A and a token of B end at the same byte, a group closes. Inside
one task a text's tokens are cut by byte ranges; a byte range gives a fragment: an open prefix (tokens up to its first
common end), closed groups, an open suffix. Fragments form a monoid: the suffix of one and the prefix of the next close a group, and a
fragment without a common end is open as a whole. A text of one range is finished where it was encoded; those of longer
texts are dealt to tasks and composed in a tree, ``FAN`` neighbours at a time, with only prefixes and suffixes moving up.

Overlapping pairs of two tilings are the stretches between successive ends of either, so links are read off the merged ends. The number of
documents that hold a pair of ids linked is counted over the corpus; documents read the counts back by broadcast joins
with slices of at most about ``SLICE`` pairs each, so what is broadcast does not grow with the data.

Encoding by stretches (white space and the word after it) is exact for pre-tokenizers that cut there and for piece vocabularies
without a piece that crosses such a border; both are checked on the vocabulary, and whole texts are encoded otherwise.

Defined results: null and empty texts, and texts whose token bytes do not give the text again under A or B, have no tokens:
zeros and an empty digest. Every row gives a row; rows that share an id are documents each, rows with a null id too. Texts of any length
are used whole. Ties for an A id's highest count all count as best. Other columns are not read, whatever they are called. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from memoloom.llm.storage import cut_small, written
from memoloom.llm.tokens import tokenizer

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text that one fragment covers, fragments that one step composes, pairs of ids in one broadcast.
RANGE = 1 << 16
FAN = 16
SLICE = 1 << 20
#: Stretches after which a worker starts a new generation of what it remembers, and new ones that go to a tokenizer as one text.
REMEMBERED = 150_000
TOGETHER = 64

_STRETCH = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
_SPACE_AND_WORD = re.compile(r" \S+")


class Pair:
    """Both tokenizers, and the id bytes of stretches they have met."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        self.a, self.b = tokenizer(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            stated = json.load(f)
        letters = _byte_letters()
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            known = all(c in letters for c in name)
            self.a_bytes[i] = bytes(letters[c] for c in name) if known else name.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        if len(self.a_bytes) * len(self.b_bytes) >= 1 << 31:
            raise ValueError("a pair of ids must fit in 31 bits")
        self.space = self.b.piece_to_id("▁")
        cuts = stated["pre_tokenizer"] or {}
        by_stretch = stated["normalizer"] is None and cuts.get("type") == "ByteLevel" and cuts.get("use_regex") and not cuts.get("add_prefix_space")
        crossing = re.compile(r"[^\s▁][\n▁ ]")
        self.by_stretch = bool(by_stretch) and not any(crossing.search(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.remembered, self.known, self.before = remembered, ({}, {}), ({}, {})  # A's and B's; None where a text is lost
        self.digits = self._digits()

    def _piece(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def _digits(self) -> np.ndarray:
        """Ids in decimal behind their separators: A after ',' and ';', B after ',' and '|'."""
        a, b = range(len(self.a_bytes)), range(len(self.b_bytes))
        return np.array([f"{c}{i}" for c, ids in ((",", a), (";", a), (",", b), ("|", b)) for i in ids], "S")

    def _both(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of each text under A and, where its first space is the mark that B adds, under B; None if they don't give it again."""
        out = []
        first = self.a.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        second = self.b.encode([t[1:] if t.startswith(" ") else t for t in texts], num_threads=1) if texts else []
        for text, a, b in zip(texts, first, second, strict=True):
            a = a.ids
            if text == " ":
                b = [self.space]  # an empty text gets no leading mark
            elif not text.startswith(" "):
                b = b[1:] if b and b[0] == self.space else [0]
            data = text.encode()
            same = b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b])
            out.append((np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if same else None)
        return out

    def _learn(self, fresh: set[str]) -> None:
        """Remember the id bytes of stretches. Words behind one space go many to a text, whose ids are cut where they end; stretches
        of a text that can't be cut so, and all others, are texts each."""
        words = [s for s in fresh if _SPACE_AND_WORD.fullmatch(s)]
        left = list(fresh.difference(words))
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        texts = ["".join(g) for g in groups]
        first = self.a.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        second = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        for group, text, a, b in zip(groups, texts, first, second, strict=True):
            data = text.encode()
            ends = np.cumsum([len(s) for s in group] if len(data) == len(text) else [len(s.encode()) for s in group])
            a, b = self._cut(a.ids, self.a_bytes, self.a_sizes, data, ends), self._cut(b, self.b_bytes, self.b_sizes, data, ends)
            if a is None or b is None:
                left += group
                continue
            for known, ids in zip(self.known, (a, b), strict=True):
                known.update(zip(group, ids, strict=True))
        for s, found in zip(left, self._both(left), strict=True):
            for known, ids in zip(self.known, found or (None, None), strict=True):
                known[s] = ids

    @staticmethod
    def _cut(ids: list[int], table: list[bytes], sizes: np.ndarray, data: bytes, ends: np.ndarray) -> list[bytes] | None:
        """Id bytes between successive ends in a text; None if the tokens don't give it again or one reaches across an end."""
        if b"".join(map(table.__getitem__, ids)) != data:
            return None
        ids = np.array(ids, np.int32)
        run = np.cumsum(sizes[ids])
        at = np.searchsorted(run, ends)
        if (run[at] != ends).any():
            return None
        raw, cuts = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
        return [raw[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Id bytes of every text with a leading space, empty where a text has no tokens."""
        spaced = [" " + t if t else "" for t in texts]
        if not self.by_stretch:
            found = iter(self._both([s for s in spaced if s]))
            return [(next(found) or (b"", b"")) if s else (b"", b"") for s in spaced]
        if len(self.known[0]) > self.remembered:
            self.known, self.before = ({}, {}), self.known
        cut = [_STRETCH.findall(s) for s in spaced]
        fresh = set().union(*cut).difference(self.known[0])
        again = fresh.intersection(self.before[0])
        for known, before in zip(self.known, self.before, strict=True):
            known.update(zip(again, map(before.__getitem__, again), strict=True))
        self._learn(fresh.difference(again))
        out = []
        for stretches in cut:
            a = list(map(self.known[0].__getitem__, stretches))
            lost = None in a
            out.append((b"", b"") if lost else (b"".join(a), b"".join(map(self.known[1].__getitem__, stretches))))
        return out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pair(a_path: str, b_path: str) -> Pair:
    """The tokenizers of this worker process; tasks of one worker share them."""
    shared = sys.modules.setdefault("_memoloom_pairs", types.ModuleType("_memoloom_pairs"))
    name = f"{a_path} {b_path}"
    if name not in shared.__dict__:
        setattr(shared, name, Pair(a_path, b_path))
    return getattr(shared, name)


class Ranges:
    """Tokens of several byte ranges side by side: ids, ends on one line, and which range a token belongs to.

    A range is closed at its start if a text begins there; all others begin inside of groups. ``extent`` is the room that a range
    takes on the line, at least as far as its last end."""

    def __init__(self, own: Pair, a: list[np.ndarray], b: list[np.ndarray], a_end: np.ndarray, b_end: np.ndarray, extent: np.ndarray, starts: np.ndarray):
        self.own, self.rows = own, len(a)
        base = np.cumsum(extent) - extent
        self.a, self.a_row, self.a_ends = self._line(a, own.a_sizes, base + a_end)
        self.b, self.b_row, self.b_ends = self._line(b, own.b_sizes, base + b_end)
        at = np.minimum(np.searchsorted(self.b_ends, self.a_ends), max(len(self.b_ends) - 1, 0))
        both = self.b_ends[at] == self.a_ends if len(self.b_ends) else np.zeros(len(self.a_ends), bool)
        cuts, cut_row = self.a_ends[both], self.a_row[both]
        closed = np.r_[True, cut_row[1:] != cut_row[:-1]] if len(cuts) else np.zeros(0, bool)
        inner = ~closed | starts[cut_row]
        self.first_cut = np.full(self.rows, False)
        self.first_cut[cut_row] = True
        self.n_groups = np.bincount(cut_row[inner], minlength=self.rows)
        self.a_group, self.a_place = self._placed(self.a_ends, self.a_row, cuts, cut_row, inner)
        self.b_group, self.b_place = self._placed(self.b_ends, self.b_row, cuts, cut_row, inner)

    @staticmethod
    def _line(parts: list[np.ndarray], sizes: np.ndarray, ends: np.ndarray):
        """Ids in a row, their ranges, and ends such that the last one of each range is the one given."""
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        lengths = np.array([len(p) for p in parts], np.int64)
        row = np.repeat(np.arange(len(parts)), lengths)
        run = np.cumsum(sizes[ids])
        last = np.cumsum(lengths) - 1
        shift = np.where(lengths > 0, ends - (run[np.maximum(last, 0)] if len(run) else 0), 0)
        return ids, row, run + shift[row]

    @staticmethod
    def _placed(ends, row, cuts, cut_row, inner):
        """Group of every token, and its place: 0 in the open prefix, 1 in a closed group, 2 in the open suffix."""
        group = np.searchsorted(cuts, ends)
        inside = group < len(cuts)
        at = np.where(inside, group, 0)
        mine = inside & (cut_row[at] == row) if len(cuts) else inside
        return group, np.where(mine, np.where(inner[at], 1, 0) if len(cuts) else 0, 2)

    def texts(self) -> list[bytes]:
        """The closed groups of every range, as 'a1,a2|b1;a3|b2,b3'."""
        a, b = self.a_place == 1, self.b_place == 1
        group = np.r_[self.a_group[a], self.b_group[b]]
        side = np.r_[np.zeros(a.sum(), np.int64), np.ones(b.sum(), np.int64)]
        order = np.argsort(group * 2 + side, kind="stable")
        ids = np.r_[self.a[a], self.b[b]].astype(np.int64)[order]
        group, side = group[order], side[order]
        head = np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])] if len(ids) else np.zeros(0, bool)
        n_a, n_b = len(self.own.a_bytes), len(self.own.b_bytes)
        letters = self.own.digits[ids + side * 2 * n_a + head * np.where(side == 1, n_b, n_a)]
        ends = np.cumsum(np.bincount(self.a_row[a], minlength=self.rows) + np.bincount(self.b_row[b], minlength=self.rows))
        data, width = letters.tobytes(), letters.dtype.itemsize
        return [data[s * width : e * width].replace(b"\0", b"")[1:] for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(links of every range, distinct pairs of every range, their codes, their times) over closed groups."""
        ends = np.sort(np.r_[self.a_ends[self.a_place == 1], self.b_ends[self.b_place == 1]], kind="stable")  # two ascending runs
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
        i, j = np.searchsorted(self.a_ends, ends), np.searchsorted(self.b_ends, ends)
        codes = self.a[i].astype(np.int64) * len(self.own.b_bytes) + self.b[j] if len(ends) else np.zeros(0, np.int64)
        row = self.a_row[i] if len(ends) else np.zeros(0, np.int64)
        keys, times = np.unique((row << 31) | codes, return_counts=True)
        distinct = np.bincount(keys >> 31, minlength=self.rows)
        return np.bincount(row, minlength=self.rows), distinct, keys & ((1 << 31) - 1), times

    def open_parts(self, place: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of the open prefix (0) or suffix (2) of every range."""
        out = []
        for ids, row, at in ((self.a, self.a_row, self.a_place), (self.b, self.b_row, self.b_place)):
            chosen = at == place
            cuts = np.cumsum(np.bincount(row[chosen], minlength=self.rows))[:-1]
            out.append(np.split(ids[chosen], cuts))
        return out[0], out[1]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values.astype(np.int32)))


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    return _lists(np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array([len(p) for p in parts], np.int64))


_DOC = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<int>"
_RANGE = "seq int, a array<int>, b array<int>, a_end long, b_end long, start boolean"


def _encoded(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Finished documents of one range (seq null), and the ranges of longer ones, of rows (doc_id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        row = TaskContext.get().partitionId() << 33
        for batch in cut_small(batches):
            names = batch.column(0).to_pylist()
            ids = [tuple(np.frombuffer(x, np.int32) for x in p) for p in own.encode(batch.column(1).to_pylist())]
            sizes = [int(own.a_sizes[a].sum()) for a, _ in ids]
            short = [k for k, n in enumerate(sizes) if n <= RANGE]
            if short:
                yield finished(own, row, short, [names[k] for k in short], [ids[k] for k in short], np.array([sizes[k] for k in short]))
            for k, n in enumerate(sizes):
                if n > RANGE:
                    yield ranges(own, row + k, names[k], *ids[k])
            row += len(names)

    def finished(own, row, at, names, ids, sizes) -> pa.RecordBatch:
        found = Ranges(own, [a for a, _ in ids], [b for _, b in ids], sizes, sizes, sizes, np.ones(len(ids), bool))
        n_links, distinct, codes, times = found.links()
        digests = [hashlib.sha256(t).hexdigest() if t else "" for t in found.texts()]
        counts = [np.array([len(x[s]) for x in ids], np.int64) for s in (0, 1)]
        columns = [pa.array(row + np.array(at, np.int64)), pa.array(names, pa.int64()), *map(pa.array, counts), pa.array(found.n_groups), pa.array(n_links)]
        columns += [pa.array(digests), _lists(codes, distinct), _lists(times, distinct)]
        return full(columns, len(ids))

    def ranges(own, row, name, a, b) -> pa.RecordBatch:
        """The tokens of a long text by the byte range in which they end."""
        cut = []
        for ids, lengths in ((a, own.a_sizes), (b, own.b_sizes)):
            ends = np.cumsum(lengths[ids])
            borders = np.arange(RANGE, ends[-1] + RANGE, RANGE)
            to = np.searchsorted(ends, borders, "right")
            parts = np.split(ids, to[:-1])
            cut.append((parts, np.where(to > 0, ends[np.maximum(to, 1) - 1], 0) - (borders - RANGE)))
        (a_parts, a_end), (b_parts, b_end) = cut
        n = len(a_parts)
        zeros = pa.array(np.zeros(n, np.int64))
        columns = [pa.array(np.full(n, row)), pa.array([name] * n, pa.int64()), pa.array([len(p) for p in a_parts], pa.int64()), pa.array([len(p) for p in b_parts], pa.int64())]
        columns += [zeros, zeros, pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int32())), pa.array(np.arange(n, dtype=np.int32))]
        columns += [_arrays(a_parts), _arrays(b_parts), pa.array(a_end), pa.array(b_end), pa.array(np.arange(n) == 0)]
        return pa.RecordBatch.from_arrays(columns, _names)

    def full(columns: list, n: int) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, k) for k in kinds]], _names)

    _names = [c.split()[0] for c in f"{_DOC}, {_RANGE}".split(", ")]
    return rows.mapInArrow(task, f"{_DOC}, {_RANGE}")


#: kind 0: a part of a document's closed groups; kind 1: a fragment. ``at`` is the range of a fragment's first common end.
_PART = "kind int, row long, seq long, place int, n_groups long, n_links long, text string, codes array<int>, times array<int>"
_FRAGMENT = "cut boolean, at long, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>"
_MOVED = [c.split()[0] for c in f"{_PART}, {_FRAGMENT}".split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
_KINDS += [pa.bool_(), pa.int64(), *[pa.list_(pa.int32())] * 4]


def _moved(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(_MOVED, _KINDS, strict=True)], _MOVED)


class Fragment:
    """Tokens around the closed groups of neighbouring ranges: those before the first common end and after the last one."""

    def __init__(self, cut: bool, at: int | None, head: tuple[list, list], tail: tuple[list, list]):
        self.cut, self.at, self.head, self.tail = cut, at, head, tail

    def then(self, other: Fragment) -> tuple[Fragment, tuple[list, list] | None]:
        """The fragment of both, and the group that closes between them."""
        join = lambda x, y: (x[0] + y[0], x[1] + y[1])
        if self.cut and other.cut:
            return Fragment(True, self.at, self.head, other.tail), join(self.tail, other.head)
        if self.cut:
            return Fragment(True, self.at, self.head, join(self.tail, other.head)), None
        return Fragment(other.cut, other.at, join(self.head, other.head), other.tail), None


def _fragments(ranges: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The fragment of every range, and a part for its closed groups."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        for batch in cut_small(batches, 16):
            if not batch.num_rows:
                continue
            rows = batch.to_pydict()
            ids = [[np.array(x, np.int32) for x in rows[c]] for c in ("a", "b")]
            starts = np.array(rows["start"], bool)
            found = Ranges(own, *ids, np.array(rows["a_end"]), np.array(rows["b_end"]), np.full(batch.num_rows, RANGE), starts)
            n_links, distinct, codes, times = found.links()
            cuts = np.cumsum(distinct)[:-1]
            codes, times, texts = np.split(codes, cuts), np.split(times, cuts), found.texts()
            head, tail = found.open_parts(0), found.open_parts(2)
            out = []
            for k in range(batch.num_rows):
                same = {"row": rows["row"][k], "seq": rows["seq"][k]}
                if found.n_groups[k]:
                    sums = {"n_groups": int(found.n_groups[k]), "n_links": int(n_links[k]), "text": texts[k].decode()}
                    out.append({"kind": 0, **same, "place": 1, **sums, "codes": codes[k], "times": times[k]})
                cut = bool(found.first_cut[k] or starts[k])
                edge = (tail, head) if not cut else (head, tail)  # without a common end all is open on both sides
                out.append({"kind": 1, **same, "cut": cut, "at": rows["seq"][k] if cut else None, "head_a": edge[0][0][k], "head_b": edge[0][1][k], "tail_a": edge[1][0][k], "tail_b": edge[1][1][k]})
            yield _moved(out)

    return ranges.repartition("row", "seq").mapInArrow(task, f"{_PART}, {_FRAGMENT}")


def _composed(fragments: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``FAN`` neighbours to one fragment each, and parts for the groups that close between them."""
    spread = fragments.withColumn("up", F.expr(f"seq div {FAN}")).repartition("row", "up").sortWithinPartitions("row", "seq")
    columns = ["row", "up", "cut", "at", "head_a", "head_b", "tail_a", "tail_b"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        key, held = None, None
        for batch in batches:
            out = []
            for row, up, cut, at, *edges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = Fragment(cut, at, (edges[0], edges[1]), (edges[2], edges[3]))
                if (row, up) != key:
                    if key is not None:
                        out.append(shown(key, held))
                    key, held = (row, up), one
                    continue
                held, group = held.then(one)
                if group is not None:
                    out.append(closed(own, row, one.at, *group))
            if out:
                yield _moved(out)
        if key is not None:
            yield _moved([shown(key, held)])

    def shown(key, f: Fragment) -> dict:
        return {"kind": 1, "row": key[0], "seq": key[1], "cut": f.cut, "at": f.at, "head_a": f.head[0], "head_b": f.head[1], "tail_a": f.tail[0], "tail_b": f.tail[1]}

    def closed(own: Pair, row: int, at: int, a: list, b: list) -> dict:
        a, b = np.array(a, np.int32), np.array(b, np.int32)
        end = np.array([own.a_sizes[a].sum()])
        group = Ranges(own, [a], [b], end, end, end, np.ones(1, bool))
        n_links, _, codes, times = group.links()
        return {"kind": 0, "row": row, "seq": at, "place": 0, "n_groups": 1, "n_links": int(n_links[0]), "text": group.texts()[0].decode(), "codes": codes, "times": times}

    return spread.select(*columns).mapInArrow(task, f"{_PART}, {_FRAGMENT}")


def _long_texts(ranges: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Documents of several ranges: (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256), and (row, code, times)."""
    level = written(_fragments(ranges, a_path, b_path), "alignment-fragments")
    parts = [level.where("kind = 0")]
    while level.where("kind = 1 and seq > 0").limit(1).count():
        level = written(_composed(level.where("kind = 1"), a_path, b_path), "alignment-composed")
        parts.append(level.where("kind = 0"))
    parts = reduce(DataFrame.union, parts)
    named = ranges.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "place", "text")))  # the parts of one text
    joined = parts.groupBy("row").agg(F.sum("n_groups").alias("n_groups"), F.sum("n_links").alias("n_links"), ordered.alias("parts"))
    digest = F.sha2(F.array_join(F.col("parts.text"), ";"), 256)
    docs = named.join(joined, "row").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"))
    pairs = parts.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).groupBy("row", F.col("p.codes").alias("code"))
    return docs, pairs.agg(F.sum("p.times").alias("times"))


def pair_counts(codes: DataFrame, n_b: int) -> DataFrame:
    """(code, n, best): documents that hold each pair of ids, of rows (code) distinct per document, and whether no other pair of
    the same A id is in more."""
    counts = written(codes.groupBy("code").agg(F.count("*").alias("n")), "alignment-counts")
    a = F.expr(f"code div {n_b}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, a == F.col("a")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_LEVEL, b_path: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = written(_encoded(rows, a_path, b_path), "alignment-encoded")
    done = encoded.where("seq is null")
    longer, long_pairs = _long_texts(encoded.where("seq is not null"), a_path, b_path)
    longer, long_pairs = written(longer, "alignment-long"), written(long_pairs, "alignment-long-pairs")
    n_b = SentencePieceProcessor(model_file=b_path).get_piece_size()
    counts = written(pair_counts(done.select(F.explode("codes").alias("code")).union(long_pairs.select("code")), n_b), "alignment-pairs")
    held = done.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row", "p.codes", "p.times").union(long_pairs)
    held = held.toDF("row", "code", "times")
    slices = max(1, -(-counts.count() // SLICE))
    sums = []
    for k in range(slices):
        part = counts.where(F.pmod(F.xxhash64("code"), F.lit(slices)) == k)  # at most about SLICE rows of 17 bytes
        met = held.join(F.broadcast(part), "code").groupBy("row")
        sums.append(met.agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    totals = reduce(DataFrame.union, sums).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    whole = done.select(*columns).union(longer.select(*columns)).join(totals, "row", "left")
    own = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *own, "groups_sha256")
