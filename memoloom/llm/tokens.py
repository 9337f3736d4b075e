"""Token ids of whole texts, and their binary files.

``Encoder`` gives exactly the ids of the tokenizer library for a whole text: its pattern never reaches across white space,
so a text is encoded by its words, and each distinct word is encoded once per worker.

``write_ids`` deals documents into id order, encodes them and writes groups of documents as Simple-8b payloads; the groups
are rows of Parquet files, so Spark's commit protocol covers lost executors. ``read_ids`` decodes them again.

Defined results: a null text is empty and has only its end id; rows with a null id come first; rows that share an id
follow each other, ordered by text. Texts of any length are one value; a group holds at least one document.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memoloom.llm.simple8b import decode, encode
from memoloom.llm.storage import cut_sized, give_back
from memoloom.workspace import materialized

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Distinct words after which a worker starts a new generation of what it remembers; the one before stays at hand, so a
#: worker holds twice as many at most, of about 200 bytes each. Fewer cost time, not results.
GENERATION = 400_000
GROUP_IDS = 1 << 20
GROUP_DOCS = 1 << 12


#: Marks after a letter; with ASCII capitals they do not change how the rest of a word is cut.
MARKS = ".,;:!?%&*$#|"


def tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer, at work in its caller's thread: a task has one core, and every thread that the library starts
    would keep memory of its own in a worker that lives on."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def parts(word: str) -> tuple[str, ...]:
    """The shorter words whose ids put together are those of a word."""
    if "<" in word:  # may hold a special token, which is matched as it is written
        return (word,)
    core = word.rstrip(MARKS)
    if len(core) < len(word) and core[-1:].isalpha():
        return (core.lower() if core.isascii() else core, word[len(core) :])
    return (word.lower() if word.isascii() else word,)


def gathered(values: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values (of these sizes, one after the other) in the order they are chosen, and where each of them ends."""
    start, own = (np.cumsum(size) - size)[chosen], size[chosen]
    ends = np.cumsum(own)
    return values[np.repeat(start - (ends - own), own) + np.arange(own.sum())], ends


class Encoder:
    """Ids by the tokenizers library, without special tokens, as little-endian unsigned 32-bit bytes. What is new in a batch
    of texts goes to the library in one call; words of letters alone go many to a text, each ending with its word-final id."""

    together = 64

    def __init__(self, path: str, remembered: int = GENERATION):
        self.tokenizer, self.remembered = tokenizer(path), remembered
        names = self.tokenizer.get_vocab()
        self.final = np.zeros(max(names.values()) + 1, bool)
        self.final[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Arrow cuts the texts and numbers their distinct words; only these are looked up."""
        if len(self.words) > self.remembered:
            self.words, self.before = {"": b""}, self.words
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = pc.split_pattern(pc.replace_substring(column.fill_null(""), "\n", " "), " ")
        words = pc.dictionary_encode(cut.flatten())
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(set(distinct).difference(self.words))
        ids = list(map(self.words.__getitem__, distinct))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        found, ends = gathered(np.frombuffer(b"".join(ids), "<u4"), size, words.indices.to_numpy())
        cuts = (np.r_[0, ends][np.asarray(cut.offsets)] * 4).tolist()
        data = found.tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _recalled(self, words: set[str]) -> list[str]:
        """Take words over from the generation before; those that it does not know either."""
        before, left = self.before, []
        for word in words:
            ids = before.get(word)
            if ids is None:
                left.append(word)
            else:
                self.words[word] = ids
        return left

    def _asked(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []

    def _learn(self, words: set[str]) -> None:
        known = self.words
        new = self._recalled(words)
        letters = [word for word in new if word.isascii() and word.isalpha() and word.islower()]  # most, and whole
        cut = {word: parts(word) for word in set(new).difference(letters)}
        asked = {word for word, own in cut.items() if own == (word,)}
        for word in asked:
            del cut[word]
        asked.update(self._recalled(set().union(*cut.values()).difference(known, asked, letters)))
        more = [word for word in asked if normalize("NFC", word).lower().isalpha()]
        left = asked.difference(more)
        letters += more
        groups = [letters[k : k + self.together] for k in range(0, len(letters), self.together)]
        for words, found in zip(groups, self._asked([" ".join(g) for g in groups]), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self.final[ids]) + 1) * 4
            if len(ends) != len(words):
                left.update(words)
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(words, ends.tolist(), strict=True):
                known[word] = data[start:end]
                start = end
        left = list(left)
        for word, found in zip(left, self._asked(left), strict=True):
            known[word] = array("I", found.ids).tobytes()
        for word, own in cut.items():
            known[word] = known[own[0]] + known[own[1]] if len(own) == 2 else known[own[0]]


def encoder(path: str, remembered: int = GENERATION) -> Encoder:
    """The encoder of this worker process; tasks of one worker share it."""
    shared = sys.modules.setdefault("_memoloom_encoders", types.ModuleType("_memoloom_encoders"))
    name = f"{path} {remembered}"
    if name not in shared.__dict__:
        setattr(shared, name, Encoder(path, remembered))
    return getattr(shared, name)


def encoded(
    batches: Iterator[pa.RecordBatch], path: str, text: int, remembered: int = GENERATION
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut small, each with the id bytes of its texts. Where fewer words are to be remembered than usual, the encoder
    goes with its task."""
    frugal = remembered < GENERATION
    own = Encoder(path, remembered) if frugal else encoder(path, remembered)
    for part in cut_sized(batches, text):
        yield part, own.encode(part.column(text))
    if frugal:
        del own
        give_back()


GROUPS = "part int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_ids(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the ids of all documents, each closed by the end id, in ascending id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def group(part: int, first: int, names: list[int | None], ids: list[bytes]) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(ids), "<u4")
        lengths = [len(x) // 4 for x in ids]
        row = ([part], [first], [len(values)], [names], [lengths], [encode(values)])
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        columns = [pa.array(v, k) for v, k in zip(row, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["part", "first", "n_ids", "doc_ids", "lengths", "payload"])

    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, held, names, ids = 0, 0, [], []
        for batch, found in encoded(batches, vocabulary, 1):
            for name, data in zip(batch.column(0).to_pylist(), found, strict=True):
                names.append(name)
                ids.append(data + end)
                held += len(data) // 4 + 1
                if held >= GROUP_IDS or len(ids) >= GROUP_DOCS:
                    yield group(part, first, names, ids)
                    first, held, names, ids = first + held, 0, [], []
        if ids:
            yield group(part, first, names, ids)

    ordered.mapInArrow(write, GROUPS).write.mode("errorifexists").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, and the ids on demand."""
    groups = spark.read.schema(GROUPS).parquet(path)
    totals = groups.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as the writer had tasks
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialized(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "token-bases")  # size known
    rows = groups.join(bases, "part").select((F.col("base") + F.col("first")).alias("first"), "doc_ids", "lengths", "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = decode(row["payload"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                cuts = list(zip(starts.tolist(), ends.tolist(), strict=True))
                sums = [zlib.crc32(data[a:b]) for a, b in cuts]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"])]
                columns += [pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([data[a:b].tolist() for a, b in cuts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(read, schema)
