"""JSON arrays of any size, read by many tasks: byte ranges, a structural scan, elements whose borders lie anywhere.

A first pass over byte ranges ("blocks") notes what each does to the structure: how many quotes that are not escaped, and, for a
block that starts outside or inside a string, how it changes the nesting. Running sums over the blocks of a file (some numbers a
block) tell where each block stands, so a second pass cuts out the elements. A block yields the elements that start in it
and reads on where one ends behind it.

Brackets, commas and quotes are single bytes in UTF-8, so borders inside characters do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memoloom.sources.files import existing
from memoloom.sources.listing import list_all, opened

BLOCK_BYTES = 16 << 20
#: Bytes of elements that a task holds before it hands them on; a longer element is handed on alone.
_BATCH_BYTES = 4 << 20
#: Bytes of a block that are looked at at a time: the places of brackets and quotes take many times as much.
_WINDOW_BYTES = 1 << 20
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_OPENING, _CLOSING = b"[{", b"]}"
_WHITE = b" \t\r\n"

_STEP = np.zeros(256, np.int8)
_STEP[list(_OPENING)], _STEP[list(_CLOSING)] = 1, -1
_STRUCTURAL = np.zeros(256, bool)
_STRUCTURAL[[*_OPENING, *_CLOSING, _COMMA, _QUOTE]] = True

# what a block does if it starts outside a string, and if it starts inside one
_EFFECT = "delta long, low long, brackets long, closing int, commas map<long,long>"
_SUMMARY = f"path string, start long, length long, escaped boolean, quotes long, first int, last int, outer struct<{_EFFECT}>, inner struct<{_EFFECT}>"
_EFFECT_TYPE = pa.struct(
    [("delta", pa.int64()), ("low", pa.int64()), ("brackets", pa.int64()), ("closing", pa.int32()), ("commas", pa.map_(pa.int64(), pa.int64()))]
)
_SUMMARY_TYPE = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("escaped", pa.bool_()), ("quotes", pa.int64())]
    + [("first", pa.int32()), ("last", pa.int32()), ("outer", _EFFECT_TYPE), ("inner", _EFFECT_TYPE)]
)


def _marks(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and bytes of brackets, commas and quotes, escaped quotes left out; whether the byte behind the data is escaped.

    `escaped` says so of the first byte: an odd number of backslashes stands before it.
    """
    at = np.flatnonzero(_STRUCTURAL[data])
    slashes = np.flatnonzero(data == _BACKSLASH)
    behind = escaped and not len(data)
    hidden = np.array([0] if escaped else [], np.int64)
    if len(slashes):
        breaks = np.flatnonzero(np.diff(slashes) != 1)
        first = slashes[np.concatenate([[0], breaks + 1])]
        last = slashes[np.concatenate([breaks, [len(slashes) - 1]])]
        odd = (last - first + 1 + (escaped & (first == 0))) % 2 == 1
        if escaped and first[0] == 0:
            hidden = hidden[:0]
        ends = last[odd] + 1
        behind = bool(len(ends) and ends[-1] == len(data))
        hidden = np.concatenate([hidden, ends])
    if len(hidden):
        at = at[~((data[at] == _QUOTE) & np.isin(at, hidden))]
    return at, data[at], behind


def _outside(at: np.ndarray, kind: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """The brackets and commas outside of strings."""
    quotes = kind == _QUOTE
    out = ~quotes & ((np.cumsum(quotes) + inside) % 2 == 0)
    return at[out], kind[out]


class _Effect:
    """How a block changes the nesting: in all, its lowest point before the last bracket, and commas by relative depth; added up
    window by window."""

    def __init__(self, inside: bool):
        self.inside = inside
        self.delta, self.low, self.brackets, self.closing = 0, None, 0, None
        self.commas: dict[int, int] = {}
        self._last = None  # depth behind the last bracket so far

    def add(self, at: np.ndarray, kind: np.ndarray) -> None:
        quotes = int((kind == _QUOTE).sum())
        _, kind = _outside(at, kind, self.inside)
        self.inside ^= quotes % 2 == 1
        step = _STEP[kind]
        depth = self.delta + np.cumsum(step, dtype=np.int64)
        places, counts = np.unique(depth[step == 0], return_counts=True)
        for place, count in zip(places.tolist(), counts.tolist(), strict=True):
            self.commas[place] = self.commas.get(place, 0) + count
        turns = np.flatnonzero(step)
        if len(turns):
            earlier = [x for x in (self.low, self._last) if x is not None]
            if len(turns) > 1:
                earlier.append(int(depth[turns[:-1]].min()))
            self.low = min(earlier) if earlier else None
            self._last, self.closing = int(depth[turns[-1]]), int(kind[turns[-1]])
            self.brackets += len(turns)
        self.delta = int(depth[-1]) if len(depth) else self.delta

    def row(self) -> dict:
        found = {"delta": self.delta, "low": self.low, "brackets": self.brackets, "closing": self.closing}
        return found | {"commas": sorted(self.commas.items())}


def _preceded(source: pa.NativeFile, start: int) -> bool:
    """Whether an odd number of backslashes stands right before a place."""
    count = 0
    while start > 0:
        took = min(start, 4096)
        piece = source.read_at(took, start - took)
        run = took - len(piece.rstrip(b"\\"))
        count += run
        if run < took:
            break
        start -= took
    return count % 2 == 1


def _summary(source: pa.NativeFile, start: int, length: int) -> dict:
    before = escaped = _preceded(source, start)
    quotes, first, last, outer, inner = 0, None, None, _Effect(False), _Effect(True)
    place, end = start, start + length
    while place < end:
        text = source.read_at(min(_WINDOW_BYTES, end - place), place)
        if not text:
            break
        at, kind, escaped = _marks(np.frombuffer(text, np.uint8), escaped)
        quotes += int((kind == _QUOTE).sum())
        outer.add(at, kind)
        inner.add(at, kind)
        bare = text.strip(_WHITE)
        if bare:
            first, last = bare[0] if first is None else first, bare[-1]
        place += len(text)
    return {"escaped": before, "quotes": quotes, "first": first, "last": last, "outer": outer.row(), "inner": inner.row()}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, inner, _ = opened(row["path"])
            with system.open_input_file(inner) as source:
                found = row | _summary(source, row["start"], row["length"])
            yield pa.RecordBatch.from_pylist([found], schema=_SUMMARY_TYPE)


def _pieces(source: pa.NativeFile, row: dict) -> Iterator[bytes]:
    """The elements that start in a block, in order, white space around them removed."""
    place, end = row["start"], row["start"] + row["length"]
    inside, depth, escaped = row["inside"], row["depth"], row["escaped"]
    held: list[bytes] | None = None  # parts of the element that is open; None while none is open that starts here
    while place < end or held is not None:
        text = source.read_at(min(_WINDOW_BYTES, end - place) if place < end else _WINDOW_BYTES, place)
        if not text:
            return
        data = np.frombuffer(text, np.uint8)
        at, kind, escaped = _marks(data, escaped)
        quotes = int((kind == _QUOTE).sum())
        at, kind = _outside(at, kind, inside)
        step = _STEP[kind]
        level = depth + np.cumsum(step, dtype=np.int64)
        border = ((step == 0) & (level == 1)) | ((step == 1) & (level == 1)) & (kind == _OPENING[0]) | ((step == -1) & (level == 0))
        begun = 0
        for spot, turn in zip(at[border].tolist(), step[border].tolist(), strict=True):
            if held is not None:
                held.append(text[begun:spot])
                yield b"".join(held).strip(_WHITE)
            held = [] if turn >= 0 and place < end else None
            begun = spot + 1
            if held is None and place >= end:
                return
        if held is not None:
            held.append(text[begun:])
        inside ^= quotes % 2 == 1
        depth = int(level[-1]) if len(level) else depth
        place += len(text)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(path: str, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([path] * len(held)), pa.array([p for p, _ in held], pa.int64()), pa.array([e for _, e in held], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["path", "position", "element"])

    for batch in batches:
        for row in batch.to_pylist():
            system, inner, _ = opened(row["path"])
            with system.open_input_file(inner) as source:
                if not row["is_array"]:
                    yield packed(row["path"], [(0, source.read())])
                    continue
                held, size = [], 0
                for number, piece in enumerate(_pieces(source, row), row["before"]):
                    if not piece and row["elements"] == 1:
                        continue  # an array without elements
                    if held and size + len(piece) > _BATCH_BYTES:
                        yield packed(row["path"], held)
                        held, size = [], 0
                    held.append((number, piece))
                    size += len(piece)
                if held:
                    yield packed(row["path"], held)


def _placed(summaries: DataFrame) -> DataFrame:
    """Where every block stands: inside (a string), depth, before (elements that start earlier), and of its file: elements,
    is_array (it begins with a bracket) and whole (its brackets and strings close, and nothing follows)."""
    file = Window.partitionBy("path")
    earlier = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def running(c: Column | str) -> Column:
        return F.coalesce(F.sum(c).over(earlier), F.lit(0))

    rows = summaries.withColumn("inside", running("quotes") % 2 == 1)
    rows = rows.withColumn("effect", F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).drop("inner", "outer")
    rows = rows.withColumn("depth", running("effect.delta"))
    commas = F.coalesce(F.try_element_at("effect.commas", 1 - F.col("depth")), F.lit(0))
    opens = (F.col("depth") == 0) & (F.col("effect.brackets") > 0)
    rows = rows.withColumn("starts", commas + opens.cast("long"))
    after = F.col("depth") + F.col("effect.delta")
    final = F.max(F.when(F.col("effect.brackets") > 0, F.col("start"))).over(file)
    closed = (F.col("start") == final) & (after == 0) & (F.col("effect.closing") == _CLOSING[0])
    sound = F.coalesce(F.col("depth") + F.col("effect.low") >= 1, F.lit(True))
    sound = sound & ((F.col("effect.brackets") == 0) | (F.when(F.col("start") == final, closed).otherwise(after >= 1)))
    by_start = file.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_array = F.coalesce(F.first("first", True).over(by_start) == _OPENING[0], F.lit(False))
    ends = (F.last("last", True).over(by_start) == _CLOSING[0]) & (F.sum("quotes").over(file) % 2 == 0)
    rows = rows.withColumns(
        {
            "before": running("starts"),
            "elements": F.sum("starts").over(file),
            "is_array": is_array,
            "whole": is_array & F.coalesce(F.min(F.coalesce(sound, F.lit(False))).over(file) & ends, F.lit(False)),
        }
    )
    return rows.select("path", "start", "length", "escaped", "inside", "depth", "starts", "before", "elements", "is_array", "whole")


def array_elements(
    spark: SparkSession,
    paths: list[str],
    suffix: str | None = None,
    *,
    chosen: Column | None = None,
    strict: bool = False,
    single: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """path, position (from 0) and element (JSON text as bytes) of every element of the JSON arrays at and below `paths`.

    Files are chosen by `suffix` (a pattern) or `chosen` (a condition on `path`). A file that holds no array, or one whose brackets
    and strings do not close, is an error when `strict`; else it gives nothing, but with `single` a file without a leading
    bracket is one element, whole. Elements are not checked: one that is no JSON, or empty between two commas, comes as it
    is. An empty array gives no row, an empty file nothing (an error when `strict`, unless its name starts with `_` or `.`).
    """
    found = list_all(spark, existing(spark, paths))
    found = found if suffix is None else found.where(F.col("path").rlike(suffix))
    found = found if chosen is None else found.where(chosen)
    hidden = F.col("path").rlike("/[_.][^/]*$")  # what other tools leave beside their files
    files = found.where(~((F.col("length") == 0) & hidden)).select("path", F.col("length").alias("size")).distinct()
    if strict:
        empty = F.when(F.col("size") == 0, F.raise_error(F.concat(F.lit("not a JSON array: "), "path")).cast("long"))
        files = files.withColumn("size", F.coalesce(empty, "size"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long")))
    blocks = files.where("size > 0").select("path", "size", starts.alias("start"))
    blocks = blocks.select("path", "start", F.least(F.lit(block_bytes), F.col("size") - F.col("start")).cast("long").alias("length"))
    # few rows that stand for many bytes: the number of tasks is told, as their own sizes say nothing
    count = blocks.count()
    tasks = max(1, min(count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 16)))
    summaries = blocks.repartition(tasks, "path", "start").mapInArrow(_summaries, _SUMMARY)
    placed = _placed(summaries)
    refused = F.raise_error(F.concat(F.lit("not a JSON array: "), "path")).cast("boolean") if strict else F.lit(False)
    wanted = F.when(F.col("whole"), F.col("starts") > 0)
    if single:
        wanted = wanted.when(~F.col("is_array"), F.col("start") == 0)
    wanted = wanted.otherwise(refused)
    asked = placed.where(wanted).drop("whole", "starts")
    return asked.repartition(tasks, "path", "start").mapInArrow(_elements, "path string, position long, element binary")
