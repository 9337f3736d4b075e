"""JSON arrays by byte ranges: every border in every place, against json.loads."""

import json
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from conftest import plan_of
from memoloom.plans import jobs
from memoloom.sources import array_splits, json_array, sessions
from memoloom.sources.array_splits import _marks, array_elements

ODD = ['"', "\\", '\\"', "[", "]", "{", "}", ",", "é", " ", "𝄞", " ", "\n", "x", "\\\\", ":"]


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, 5, -1.5])
    if kind < 4:
        return "".join(rng.choice(ODD) for _ in range(rng.randrange(9)))
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {value(rng, 3) if rng.random() < 0 else f"k{i}\\\"": value(rng, depth + 1) for i in range(rng.randrange(4))}


def read(df):
    return {(r["path"].rsplit("/", 1)[-1], r["position"]): json.loads(bytes(r["element"])) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_elements_of_odd_arrays(spark, tmp_path, block):
    rng = random.Random(block)
    want = {}
    for i in range(6):
        items = [value(rng) for _ in range(rng.randrange(6))]
        text = json.dumps(items, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        write(tmp_path / "in" / f"{i}.json", rng.choice(["", " \n"]) + text + rng.choice(["", "\n "]))
        want |= {(f"{i}.json", n): item for n, item in enumerate(items)}
    got = array_elements(spark, [str(tmp_path / "in")], strict=True, block_bytes=block)
    assert got.count() == len(want) and read(got) == want


def test_runs_of_backslashes_across_blocks():
    for n in range(1, 9):
        text = b'"' + b"\\" * n + b'",'
        at, _, _ = _marks(np.frombuffer(text, np.uint8), False)
        for cut in range(1, len(text)):
            left, _, escaped = _marks(np.frombuffer(text[:cut], np.uint8), False)
            right, _, _ = _marks(np.frombuffer(text[cut:], np.uint8), escaped)
            assert [*left, *(right + cut)] == at.tolist()


def test_one_element_over_many_blocks(spark, tmp_path):
    items = [{"a": "[,]" * 3000}, 1, {"b": ["\\" * 999, {}]}]
    path = write(tmp_path / "big.json", json.dumps(items))
    assert read(array_elements(spark, [path], strict=True, block_bytes=100)) == {("big.json", n): v for n, v in enumerate(items)}


BROKEN = ['[1', '["a]', "[1]]", "[1] [2]", "[1] x", "[[1]", "]", "[1}", '{"a": 1}', "[1] x]", "", " ", "5", '["a"', '[{"a": 1}']


@pytest.mark.parametrize("block", [1, 3, 100])
def test_broken_files(spark, tmp_path, block):
    paths = [write(tmp_path / f"{n}.json", text) for n, text in enumerate(BROKEN)]
    assert array_elements(spark, paths, block_bytes=block).count() == 0
    good = write(tmp_path / "good.json", "[1, 2]")
    assert read(array_elements(spark, [*paths, good], block_bytes=block)) == {("good.json", 0): 1, ("good.json", 1): 2}
    for path in paths if block == 3 else paths[:2]:
        with pytest.raises(Exception, match="not a JSON array"):
            array_elements(spark, [path], strict=True, block_bytes=block).collect()


def test_empty_arrays_missing_paths_and_hidden_names(spark, tmp_path):
    write(tmp_path / "in" / "a b%.json", "[ \n ]")
    write(tmp_path / "in" / "_c.json", "[3]")
    write(tmp_path / "in" / "_SUCCESS", "")
    root = str(tmp_path / "in")
    assert read(array_elements(spark, [root, f"{root}/none"], strict=True, block_bytes=2)) == {("_c.json", 0): 3}
    assert array_elements(spark, [f"{root}/none"]).count() == 0


def test_gaps_and_unfit_elements_are_errors(spark, tmp_path):
    for n, text in enumerate(['[{"question": "a"},,{"question": "b"}]', '[{"question": "a"},]', '[{"question" 1}]', '[{"score": }]']):
        with pytest.raises(Exception, match="empty element|MALFORMED"):
            json_array.read_json_array(spark, [write(tmp_path / f"{n}.json", text)]).collect()


def test_large_array_is_read_by_many_tasks(spark, tmp_path):
    items = [{"question": f'q{i} "],[{{' * 20, "answer": "a" * (i % 50)} for i in range(4000)]
    path = write(tmp_path / "large.json", json.dumps(items, indent=2))
    rows = json_array.read_json_array(spark, [path], block_bytes=1 << 14)
    assert sorted((r["question"], r["answer"]) for r in rows.collect()) == sorted((i["question"], i["answer"]) for i in items)
    parts = array_elements(spark, [path], block_bytes=1 << 14).rdd.glom().map(len).collect()
    assert sum(parts) == 4000 and max(parts) < 2400 and sum(p > 0 for p in parts) >= 4
    assert "collect_list" not in plan_of(rows)


def test_workbooks_and_results_in_small_blocks(spark, tmp_path):
    samples = [{"session_1": [{"speaker": "A", "text": f"t{i}, ]"}], "qa": [{"question": f"q{i}", "answer": i}]} for i in range(30)]
    book = write(tmp_path / "book.json", json.dumps(samples, indent=1))
    one = write(tmp_path / "one.json", json.dumps(samples[0]))
    books = sessions.read_workbooks(spark, [book], block_bytes=64)
    assert {(r["sample"], r["text"]) for r in sessions.sessions(books).collect()} == {(i, f"A: t{i}, ]") for i in range(30)}
    assert {(r["sample"], r["ground_truth"]) for r in sessions.questions(books).collect()} == {(i, str(i)) for i in range(30)}
    assert [r["sample"] for r in sessions.read_workbooks(spark, [one], block_bytes=5).collect()] == [0]
    graded = [{"question": f"g{i}", "ground_truth": "t", "score": 1.0} for i in range(20)] + [5, {"question": " "}]
    write(tmp_path / "in" / "result_7.json", json.dumps(graded))
    write(tmp_path / "in" / "result_8.json", '{"question": "no array"}')
    found = jobs.import_payloads(spark, [str(tmp_path / "in")])
    assert found.count() == 20 and found.where("text like 'Graded item None of R7%'").count() == 20
    assert jobs.import_payloads(spark, [str(tmp_path / "in")], max_items=3).count() == 3


def test_blocks_are_summed_up_by_windows_of_any_size(monkeypatch):
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(1, 60))).encode()
        start = rng.randrange(len(text))
        found = []
        for window in (1, 2, 5, 1 << 20):
            monkeypatch.setattr(array_splits, "_WINDOW_BYTES", window)
            found.append(array_splits._summary(pa.BufferReader(text), start, len(text) - start))
        assert found[0] == found[1] == found[2] == found[3]


def test_elements_are_the_same_by_windows_of_any_size(monkeypatch):
    rng = random.Random(6)
    for _ in range(40):
        items = [value(rng) for _ in range(rng.randrange(1, 12))]
        text = json.dumps(items, ensure_ascii=False).encode()
        row = {"start": 0, "length": len(text), "inside": False, "depth": 0, "escaped": False}
        for window in (1, 3, 1 << 20):
            monkeypatch.setattr(array_splits, "_WINDOW_BYTES", window)
            assert [json.loads(x) for x in array_splits._pieces(pa.BufferReader(text), row)] == items


def test_a_block_is_not_held_with_all_its_marks():
    text = ("[" + ",".join(['{"a":["b"]}'] * 400_000) + "]").encode()
    row = {"start": 0, "length": len(text), "inside": False, "depth": 0, "escaped": False}
    tracemalloc.start()
    array_splits._summary(pa.BufferReader(text), 0, len(text))
    count = sum(1 for _ in array_splits._pieces(pa.BufferReader(text), row))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 400_000 and most < 60 << 20
