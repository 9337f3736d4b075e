"""Repeated passages against a dictionary of all windows, and the index against plain substring search."""

import hashlib
import random

import pytest
from conftest import plan_of

from memoloom import workspace
from memoloom.llm import repeats
from memoloom.llm.run_index import RunIndex


def plain(rows, length=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, cell long, marks string")
    return sorted((tuple(r) for r in repeats.without_repeats(docs.repartition(5)).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "bé", "cde", "fghi", "日本", "the", "of", "x1", "lorem", "ipsum"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(n)) for _ in range(n))
    passages = [text(n) for n in (9, 14, 25, 60)]
    edited = passages[3][:150] + "!" + passages[3][151:]
    rows = []
    for i in rng.sample(range(1000), 120):
        parts = [text(rng.randrange(1, 30)) for _ in range(rng.randrange(3))]
        parts += rng.choices([*passages, edited, passages[3][rng.randrange(40) : rng.randrange(60, 200)]], k=rng.randrange(3))
        rng.shuffle(parts)
        rows.append((i, rng.choice((" ", "", "\n")).join(parts)))
    rows += [(2000 + i, t) for i, (_, t) in enumerate(rows[:10])]  # copies
    rows += [(3000 + i, ("und " * rng.randrange(10, 80)) + text(i + 1)) for i in range(8)] + [(3100, "und " * 3000), (3101, "q" * 400), (3102, "q" * 60 + "r")]
    rows += [(4000, None), (4001, ""), (4002, "x" * 49), (4003, "y" * 50), (4004, "y" * 50), (None, rows[0][1]), (rows[5][0], rows[6][1]), rows[7], rows[7]]
    return rows


@pytest.mark.parametrize("cell", [64, 2])
def test_against_all_windows(spark, monkeypatch, cell):
    monkeypatch.setattr(repeats, "CELL_CONTEXTS", cell)
    rows = corpus(cell)
    assert got(spark, rows) == plain(rows)


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 512)
    rows = corpus(7)
    assert got(spark, rows) == plain(rows)


def test_no_documents(spark):
    assert got(spark, []) == []


def test_kept_text_is_whole_characters(spark):
    passage = "日本語の文章" * 10
    docs = spark.createDataFrame([(1, "é" + passage), (2, "ü" + passage + "end")], "doc_id long, text string")
    rows = {r["doc_id"]: r["kept_text"] for r in repeats.without_repeats(docs, with_text=True).collect()}
    assert rows[1] == "é" + passage and rows[2] == "üend"


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(60):
        letters = rng.choice((b"ab", b"abc\x00\xff", b"abcdefgh"))
        base = bytes(rng.choice(letters) for _ in range(40))
        edit = lambda: bytes(c if rng.random() > 0.05 else rng.choice(letters) for c in base)[rng.randrange(9) :]
        texts, streams = [edit() for _ in range(rng.randrange(1, 8))], [edit() + rng.choice((b"", b"zz")) for _ in range(5)]
        lengths, ends = RunIndex(texts).matches(streams)
        begin = 0
        for stream, end in zip(streams, ends.tolist(), strict=True):
            for i in range(len(stream)):
                n = int(lengths[begin + i])
                assert any(stream[i : i + n] in t for t in texts)
                assert i + n == len(stream) or not any(stream[i : i + n + 1] in t for t in texts)
            begin = end + 1


def test_texts_go_to_one_worker_a_task(spark, monkeypatch):
    """Two Python steps in one stage would be two workers to a task, both kept."""
    plans = {}
    own = repeats.written
    monkeypatch.setattr(repeats, "written", lambda df, name: plans.update({name: plan_of(df)}) or own(df, name))
    repeats.repeated_ranges(spark.createDataFrame([(1, "x" * 60), (2, "x" * 60)], "doc_id long, text string"))
    steps = [line for line in plans["repeats-first"].splitlines() if "MapInArrow" in line or "Exchange" in line]
    assert ["Exchange" in line for line in steps] == [False, True, False]


def test_only_marks_stay_on_disk(spark, tmp_path, monkeypatch):
    """What leads to the marks is read no more once they are written."""
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}/with a space")
    rows = corpus(3)[:60]
    assert got(spark, rows) == plain(rows)
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("*/*/repeats-*")} == {"repeats-marks"}


def test_other_columns_go_along(spark):
    passage = "a passage that stands in two of the texts, word for word, from here to here"
    rows = [(1, passage, "en", 1, "m"), (2, passage + "!", None, 2, None), (3, None, "de", None, "o"), (4, "", "fr", 4, "p"), (None, passage, "it", 5, "q"), (2, passage + "!", "es", 6, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, packed string, doc int, marks string")
    cut = repeats.without_repeats(docs.repartition(3), with_text=True, others=("packed", "doc", "marks"))
    found = cut.select("doc_id", "kept_text", "others.*").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(i, "!" if i == 2 else t, *rest) for i, t, *rest in rows], key=repr)
