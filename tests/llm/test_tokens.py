"""Simple-8b round trips, ids against the tokenizer library on whole texts, files against a plain concatenation."""

import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memoloom.llm import storage, tokens
from memoloom.llm.simple8b import BLOCK, MAGIC, decode, encode


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_round_trip(values):
    data = encode(np.array(values, np.uint64))
    assert data.startswith(MAGIC) and decode(data).tolist() == values


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 77])
@pytest.mark.parametrize("top", [1, 2, 49_408, 1 << 60, 1 << 64])
def test_block_edges(n, top):
    rng = np.random.default_rng(n)
    values = rng.integers(0, top, n, dtype=np.uint64, endpoint=False) if top < 1 << 64 else rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
    assert (decode(encode(values)) == values).all()


def test_small_ids_take_little_room():
    assert len(encode(np.zeros(BLOCK * 10, np.uint64))) < BLOCK
    assert len(encode(np.full(6000, 49_407, np.uint64))) < 6000 * 8 / 3 + 200


ODD = [
    None,
    "",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>. x<|endoftext|>!",
    " \t x\r\ny\x0bz q\x1cw\x85v k m",
    "é é ́e ñ. Á!",
    "ΑΣ Σ İ ß don't I'LL 's 1234 ½ THE'S. a'.x",
    "﻿hey​there \U0001f600 ... B.,! x1% é! &amp;",
    "word" * 5000,
]


def test_ids_are_the_librarys():
    rng = random.Random(2)
    parts = ["The", "the", "CAT.", "ca't", "don't!!", "12", "a%%%", "Été,", "|", "\n", "\t", "x<", "|>", "<|endoftext|>"]
    texts = [*ODD, *(" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(200))]
    library = Tokenizer.from_file(tokens.VOCABULARY)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    own = tokens.Encoder(tokens.VOCABULARY)
    for _ in range(2):  # unknown and known words
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


def test_arrow_columns_and_their_slices():
    texts = [*ODD, "The cat sat.", None, "the cat, the CAT."]
    library = Tokenizer.from_file(tokens.VOCABULARY)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    column = pa.chunked_array([["before", *texts, "after"]]).chunk(0)
    own = tokens.Encoder(tokens.VOCABULARY)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(column.slice(1, len(texts)))] == want
    assert own.encode(column.slice(0, 0)) == [] and own.encode(pa.nulls(2, pa.string())) == [b"", b""]


@pytest.mark.parametrize(("rows", "size", "want"), [(2, 100, [2, 2, 1]), (10, 3, [2, 1, 2]), (10, 1, [1, 1, 1, 2]), (10, 9, [3, 2])])
def test_batches_are_cut_by_rows_and_bytes(rows, size, want):
    batch = pa.record_batch({"id": [1, 2, 3, 4, 5], "text": ["ab", "é", "x" * 50, None, "z"]})
    cut = list(storage.cut_sized(iter([batch, batch.slice(0, 0)]), 1, rows, size))
    assert [b.num_rows for b in cut] == want and pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_DOCS", 7)
    texts = [(i * 3 % 101, f"text number {i} " * (i % 9)) for i in range(101)] + [(500 + i, t) for i, t in enumerate(ODD)]
    texts += [(40, "again"), (40, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in texts], "doc_id long, text string, part int, payload string")
    path = str(tmp_path / "ids")
    tokens.write_ids(docs, path)
    rows = tokens.read_ids(spark, path, with_ids=True).collect()
    library = Tokenizer.from_file(tokens.VOCABULARY)
    ordered = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, t in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == want


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tokens.write_ids(docs, str(tmp_path / "none"))
    assert tokens.read_ids(spark, str(tmp_path / "none")).collect() == []


def test_the_library_starts_no_threads():
    code = """
import os, sys
from memoloom.llm import alignment, tokens
count = lambda: len(os.listdir("/proc/self/task"))
before = count()
words = [f"word{i} x{i % 7}y" for i in range(5000)]
tokens.Encoder(tokens.VOCABULARY).encode(words)
alignment.Pair(alignment.BYTE_LEVEL, alignment.PIECES).encode(words)
sys.exit(count() - before)
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    env["PYTHONPATH"] = str(Path(tokens.__file__).parents[2])
    assert subprocess.run([sys.executable, "-c", code], env=env, timeout=120).returncode == 0
