"""Files, parsers, workbooks, result sets and the memory table, over small files."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from memoloom.operators.embedding import HashEmbedder, ModelEmbedder, embed
from memoloom.plans import jobs
from memoloom.schemas import memory_schema
from memoloom.sources import files, json_array, memory_table, parsers, sessions


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_list_files_takes_known_suffixes_in_any_case(spark, tmp_path):
    for name in ("a.txt", "sub/b.MD", "sub/deep/c.Markdown", "d.jsonl", "e.json", "f.py", "g"):
        write(tmp_path / "in" / name, "x")
    root = str(tmp_path / "in")
    found = files.list_files(spark, [root, str(tmp_path / "missing")])
    assert sorted(r["path"].split("/")[-1] for r in found.collect()) == ["a.txt", "b.MD", "c.Markdown", "d.jsonl"]
    assert files.list_files(spark, [root], suffix=None).count() == 7
    assert files.list_files(spark, [str(tmp_path / "missing")]).count() == 0
    assert files.list_files(spark, [f"{root}/a.txt", f"{root}/e.json"]).count() == 1


def test_read_texts(spark, tmp_path):
    write(tmp_path / "a.txt", " \n one\r\ntwo\rthree 　")
    write(tmp_path / "b.txt", b"\xff\xfe broken")
    write(tmp_path / "c.txt", " \n")
    write(tmp_path / "empty.txt", "")
    got = {r["path"].split("/")[-1]: r["text"] for r in files.read_texts(spark, [str(tmp_path)]).collect()}
    assert got == {"a.txt": "one\ntwo\nthree", "b.txt": "", "c.txt": "", "empty.txt": ""}


def test_read_lines(spark, tmp_path):
    path = write(tmp_path / "q.txt", "first\n\n  second \x0bthird\r\n")
    assert sorted(r["line"] for r in files.read_lines(spark, [path]).collect()) == ["first", "second", "third"]


def test_question_lines(spark, tmp_path):
    path = write(tmp_path / "q.jsonl", '{"question": "q1", "ground_truth": "g", "user_id": "u"}\nplain?\n{broken\n')
    rows = sessions.question_lines(files.read_lines(spark, [path])).collect()
    assert {(r["question"], r["ground_truth"], r["user_id"]) for r in rows} == {
        ("q1", "g", "u"),
        ("plain?", None, None),
        ("{broken", None, None),
    }
    assert {r["user_id"] for r in sessions.question_lines(files.read_lines(spark, [path]), "v").collect()} == {"v"}


JSONL = [
    '{"text": " a ", "category": "fact", "scope": "user:u", "importance": "0.5", "metadata": {"source": "mine"}, "id": "i", "timestamp": 5}',
    '{"text": "", "content": "b", "metadata": [1]}',
    '{"text": "c", "importance": null}',
    '{"text": "d", "importance": "high"}',
    "[1, 2]",
    "not json",
    "",
    '{"text": "  "}',
    '{"category": "fact"}',
    '{"text": "e", "timestamp": "2023-10-01", "category": null, "scope": null}',
    '{"text": 5}',
]


def test_jsonl(spark, tmp_path):
    path = write(tmp_path / "m.JSONL", "\r\n".join(JSONL))
    lines = files.read_json_lines(spark, [path])
    got = {r["text"]: r for r in parsers.parse_jsonl(lines).collect()}
    assert set(got) == {"a", "b", "e"}
    a, b, e = (got[t] for t in "abe")
    assert (a["category"], a["scope"], a["importance"], a["id"], a["timestamp"]) == ("fact", "user:u", 0.5, "i", 5)
    assert json.loads(a["metadata"]) == {"source": "mine", "source_path": a["source_path"]}
    assert json.loads(b["metadata"]) == {"metadata_raw": [1], "source": "jsonl", "source_path": b["source_path"]}
    assert (e["category"], e["scope"], e["importance"], e["timestamp"]) == ("other", "global", 0.7, 1696118400000)
    rejects = {r["status"]: r["lines"] for r in parsers.jsonl_rejects(lines).collect()}
    assert rejects == {"invalid": 4, "empty": 3}


def test_results(spark):
    items = [{"category": 1, "question_index": i, "question": f"q{i}", "ground_truth": i, "score": 0.50} for i in range(40)]
    items[1] = 5
    items[2] = {"question": " ", "ground_truth": None}
    items[3] = {"question": "only"}
    items[4]["category"] = None
    df = spark.createDataFrame(
        [("/x/result_7.json", json.dumps(items)), ("/x/other.v2.json", json.dumps(items[:1])), ("/x/bad.json", "{}")],
        "path string, text string",
    )
    rows = parsers.parse_results(df).collect()
    first = [r["text"] for r in rows if "R7" in r["text"]]
    assert len(first) == sum(isinstance(i, dict) and bool(str(i.get("question") or i.get("ground_truth") or "").strip()) for i in items)
    assert "Graded item 0 of R7 (1). Question: q0 Ground Truth: 0 Graded with 0.5." in first
    assert "Graded item None of R7 (?). Question: only" in first
    assert any(t.startswith("Graded item 4 of R7 (None).") for t in first)
    assert [r["text"] for r in rows if "R7" not in r["text"]][0].startswith("Graded item 0 of other.v2 (1).")
    assert parsers.parse_results(df, max_items=0).count() == 2


def test_format_of_files(spark):
    names = {
        "/a/x.md": "markdown",
        "/a/x.MARKDOWN": "markdown",
        "/a/x.JsonL": "jsonl",
        "/a/result_1.json": "result",
        "/a/Result_1.json": "text",
        "/a/x.json": "text",
        "/a/x": "text",
        "/a/.md": "text",
    }
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r["path"]: r["f"] for r in df.select("path", parsers.file_format("path").alias("f")).collect()}
    assert got == names


def test_parse_files(spark):
    df = spark.createDataFrame([("/a/x.md", " m "), ("/a/y.txt", ""), ("/a/z.log", "t")], "path string, text string")
    assert sorted(r["text"] for r in parsers.parse_files(df).collect()) == ["m", "t"]
    assert parsers.parse_files(df, "text").count() == 2
    with pytest.raises(ValueError, match="unsupported input format"):
        parsers.parse_files(df, "pdf")


# ---------------------------------------------------------------------------------------------- workbooks

SAMPLE = {
    "conversation": {
        "speaker_a": "Ann",
        "session_10": [{"speaker": "Ann", "text": "ten"}],
        "session_2": [{"speaker": "Bob", "text": "two\nlines"}, {"text": "x"}, {"speaker": "Bob"}],
        "session_2_date_time": "8 May",
        "session_x": [],
        "session_2_note": "n",
        "session_1": [],
    },
    "qa": [
        {"question": "When?", "answer": 2022, "evidence": ["D1:3"], "category": 2},
        {"question": "Who?", "evidence": [], "category": 5},
    ],
}
PLAIN = {"session_1": [{"speaker": "Cy", "text": "hey"}], "session_1_date_time": ""}


@pytest.fixture
def workbook(spark, tmp_path):
    path = write(tmp_path / "book.json", json.dumps([SAMPLE, PLAIN], indent=1))
    return sessions.read_workbooks(spark, [path]).select("sample", "content")


def test_sessions(spark, workbook):
    rows = {(r["sample"], r["session"]): r for r in sessions.sessions(workbook).collect()}
    assert set(rows) == {(0, 1), (0, 2), (0, 10), (1, 1)}
    assert rows[0, 2]["text"] == "[Session Date: 8 May]\nBob: two\nlines\nUnknown: x\nBob: "
    assert rows[0, 2]["path"] == "sessions/user_0/session_2" and rows[0, 2]["timestamp"] == "8 May"
    assert rows[0, 1]["text"] == "" and rows[1, 1]["text"] == "Cy: hey"
    assert [r["session"] for r in sessions.sort_sessions(sessions.sessions(workbook).where("sample = 0")).collect()] == [1, 2, 10]


def test_session_numbers_over_many_sessions(spark):
    many = spark.range(10000).select((F.col("id") % 2).alias("sample"), (F.col("id") * 3).alias("session"))
    got = sessions.number_sessions(many).where("sample = 1").orderBy("session").collect()
    assert [r["position"] for r in got] == list(range(1, 5001))


def test_session_selection(spark, workbook):
    got = sessions.sessions(workbook, sample_range="0", session_range="2-9", user="me", path_root="r").collect()
    assert [(r["session"], r["user_id"], r["path"]) for r in got] == [(2, "me", "r/me/session_2")]


def test_questions(spark, workbook):
    rows = {r["question"]: r for r in sessions.questions(workbook).collect()}
    assert rows["When?"]["ground_truth"] == "2022" and rows["When?"]["evidence"] == ["D1:3"]
    assert rows["When?"]["category"] == "2" and rows["When?"]["user_id"] == "user_0"
    assert rows["Who?"]["ground_truth"] is None and rows["Who?"]["evidence"] == []
    parity = {r["question"]: r["ground_truth"] for r in sessions.questions(workbook, missing_answer="None").collect()}
    assert parity["Who?"] == "None"


def test_single_sample_workbook(spark, tmp_path):
    path = write(tmp_path / "one.json", json.dumps(PLAIN))
    got = sessions.sessions(sessions.read_workbooks(spark, [path])).collect()
    assert [(r["sample"], r["text"]) for r in got] == [(0, "Cy: hey")]


def test_text_lines(spark, tmp_path):
    path = write(tmp_path / "t.jsonl", '{"text": " a ", "path": "s/1", "user_id": "u"}\n{"text": "b"}\nplain\n{"path": "x"}\n')
    lines = files.read_json_lines(spark, [path])
    rows = {r["text"]: r for r in sessions.text_lines(lines).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["path"], rows["a"]["user_id"]) == ("s/1", "u")
    assert rows["b"]["path"].endswith("t.jsonl") and rows["b"]["user_id"] is None


def test_choice_between_workbook_and_files(spark, tmp_path):
    book = write(tmp_path / "Chats" / "book.json", json.dumps([SAMPLE, PLAIN]))
    notes = write(tmp_path / "notes.txt", "note")
    assert jobs.ingest_texts(spark, [book], sample_range="all", user="me").count() == 4
    assert jobs.ingest_texts(spark, [book], workbook_mark="chats").count() == 4
    assert jobs.ingest_texts(spark, [book]).count() == 0  # a JSON file is no conversation file
    assert jobs.ingest_texts(spark, [notes], user="me").first()["user_id"] == "me"
    assert jobs.eval_questions(spark, book, sample_range="0").count() == 2
    assert jobs.eval_questions(spark, notes, user="me").first()["question"] == "note"


# ---------------------------------------------------------------------------------------------- result sets


def test_json_array(spark, tmp_path):
    judged = [{"question": "q", "judge_result": {"label": "X", "score": 1}}, {"answer": "a"}]
    rows = json_array.read_json_array(spark, [write(tmp_path / "r.json", json.dumps(judged, indent=2))])
    assert rows.count() == 2
    assert rows.where("question = 'q'").first()["judge_result"]["score"] == 1.0
    assert rows.where("question is null").first()["answer"] == "a"


@pytest.mark.parametrize("content", ['{"question": "q"}', " ", "5"])
def test_json_array_refuses_other_content(spark, tmp_path, content):
    with pytest.raises(Exception, match="not a JSON array"):
        json_array.read_json_array(spark, [write(tmp_path / "r.json", content)]).collect()


def test_replace_results(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "a int, b string"
    json_array.write_results(spark.createDataFrame([(1, None), (2, "x")], schema), path)
    stored = json_array.read_results(spark, path, spark.createDataFrame([], schema).schema)
    json_array.replace_results(stored.withColumn("a", F.col("a") * 10), path)
    assert sorted(r["a"] for r in json_array.read_results(spark, path, stored.schema).collect()) == [10, 20]
    with pytest.raises(Exception, match="already exists"):
        json_array.write_results(stored, path)


# ---------------------------------------------------------------------------------------------- memory table


def entries(spark, vectors, **extra):
    rows = [(f"i{n}", "t", v, "fact", 0.5, 7, 7, "global", "{}") for n, v in enumerate(vectors)]
    names = "id string, text string, vector array<double>, category string, importance double"
    return spark.createDataFrame(rows, names + ", timestamp long, createdAt long, scope string, metadata string")


@pytest.mark.parametrize("mode", ["pro", "basic"])
def test_table(spark, tmp_path, mode):
    path = str(tmp_path / "m")
    assert memory_table.open_table(spark, path) is None
    empty = memory_table.create_table(spark, path, 2, mode)
    assert empty.count() == 0 and empty.columns == memory_schema(mode).fieldNames()
    assert memory_table.append(entries(spark, [[1.0, 0.0], [0.0, 1.0]]), path) == 2
    assert memory_table.append(entries(spark, [[1.0, 0.0]]), path) == 1
    table = memory_table.create_table(spark, path, 99, mode)  # opens; the dimension stays
    assert table.count() == 3 and memory_table.table_dimension(table) == 2
    looked = memory_table.inspect(table).first()
    assert (looked["rows"], looked["min_dimension"], looked["sample"]["id"]) == (3, 2, "i0")
    assert "vector" not in looked["sample"].asDict()


@pytest.mark.parametrize("bad", [[1.0], [1.0, 2.0, 3.0], None, [1.0, None]])
def test_append_refuses_other_vectors(spark, tmp_path, bad):
    path = str(tmp_path / "m")
    memory_table.create_table(spark, path, 2)
    with pytest.raises(Exception, match="vector dimension mismatch"):
        memory_table.append(entries(spark, [[1.0, 0.0], bad]), path)
    assert spark.read.parquet(path).count() == 0


def test_inspect_of_empty_table(spark, tmp_path):
    looked = memory_table.inspect(memory_table.create_table(spark, str(tmp_path / "m"), 2)).first()
    assert looked["rows"] == 0 and looked["sample"] is None and looked["min_dimension"] is None


def test_inspect_reads_no_vector(spark, tmp_path):
    path = str(tmp_path / "m")
    memory_table.create_table(spark, path, 2)
    memory_table.append(entries(spark, [[1.0, 0.0], [0.0, 1.0]]), path)
    looked = memory_table.inspect(memory_table.open_table(spark, path))
    plan = looked._jdf.queryExecution().explainString(looked._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert len(scans) >= 3 and not any("vector" in line for line in scans)
    assert any(line.strip() == "ReadSchema: struct<>" for line in scans)  # rows from the footers
    assert looked.first()["rows"] == 2


def test_inspect_of_rows_without_dimension(spark):
    rows = [("b", [1.0, 2.0], "x"), ("a", [1.0], "y"), (None, None, "z")]
    looked = memory_table.inspect(spark.createDataFrame(rows, "id string, vector array<float>, text string")).first()
    assert (looked["rows"], looked["min_dimension"], looked["max_dimension"]) == (3, 1, 2)
    assert looked["sample"].asDict() == {"id": "a", "text": "y"}


# ---------------------------------------------------------------------------------------------- embedding


def test_hash_embedder(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("",), (None,)], "text string")
    got = [r["vector"] for r in embed(df, HashEmbedder(10), "text").collect()]
    assert got[0] == got[2] != got[1]
    assert abs(sum(x * x for x in got[0]) - 1.0) < 1e-6
    assert got[3] == got[4] == [0.0] * 10
    assert [r["v"] for r in df.select(HashEmbedder(10, seed="s").embed_passage("text").alias("v")).collect()][0] != got[0]


def test_model_embedder(spark):
    def length_model():
        import numpy as np

        return lambda texts: np.array([[len(t), t.startswith("ask: ")] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("abc",), ("",), (None,)], "text string")
    model = ModelEmbedder(length_model, 2, normalize=False, query_instruction="ask: ")
    assert [r["vector"] for r in embed(df, model).collect()] == [[3.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    assert [r["vector"] for r in embed(df, model, query=True).collect()] == [[8.0, 1.0], [0.0, 0.0], [0.0, 0.0]]
    unit = ModelEmbedder(length_model, 2)
    assert [r["vector"] for r in embed(df, unit).collect()][0] == [1.0, 0.0]


def test_ingest_reads_json_lines(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("whole file\nof two lines")
    (tmp_path / "talks.jsonl").write_text('{"text": "a", "path": "p/1", "user_id": "u"}\nbroken\n{"text": " "}\n{"text": "b"}\n')
    rows = sorted((r["text"], r["path"].rsplit("/", 1)[-1], r["user_id"]) for r in jobs.ingest_texts(spark, [str(tmp_path)]).collect())
    assert rows == [("a", "1", "u"), ("b", "talks.jsonl", None), ("whole file\nof two lines", "notes.txt", None)]
    assert {r["user_id"] for r in jobs.ingest_texts(spark, [str(tmp_path)], user="me").collect()} == {"me"}


def test_json_is_parsed_once(spark):
    samples = spark.createDataFrame([(0, '{"session_1": [{"speaker": "a", "text": "b"}]}')], "sample int, content string")
    plan = plan_of(sessions.sessions(samples))
    assert plan.count("from_json(MapType(StringType,StringType,true), content") <= 1 or "size(" not in plan
    assert sessions.sessions(samples).first()["text"] == "a: b"


def test_empty_and_hidden_files_are_listed_and_read(spark, tmp_path):
    (tmp_path / "deep" / "_kept" / ".notes").mkdir(parents=True)
    (tmp_path / "plain.txt").write_text("plain")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "_a b%20c.md").write_text("spaced")
    (tmp_path / ".plain.txt.crc").write_bytes(b"crc")
    (tmp_path / "deep" / "_kept" / "x.txt").write_text("one\ntwo\r\n\nthree")
    (tmp_path / "deep" / "_kept" / ".notes" / ".y.jsonl").write_text('{"text": "kept"}\n')
    (tmp_path / "deep" / "other.bin").write_bytes(b"\xff")
    found = files.list_files(spark, [str(tmp_path)])
    assert sorted((r["path"].split("/")[-1], r["length"]) for r in found.collect()) == [
        (".y.jsonl", 17), ("_a b%20c.md", 6), ("empty.txt", 0), ("plain.txt", 5), ("x.txt", 15)
    ]
    texts = {r["path"].split("/")[-1]: r["text"] for r in files.read_texts(spark, [str(tmp_path)]).collect()}
    assert texts == {".y.jsonl": '{"text": "kept"}', "_a b%20c.md": "spaced", "empty.txt": "", "plain.txt": "plain", "x.txt": "one\ntwo\n\nthree"}
    lines = sorted(r["line"] for r in files.read_lines(spark, [str(tmp_path)], suffix=r"\.txt$").collect())
    assert lines == ["one", "plain", "three", "two"]
    assert [r["line"] for r in files.read_json_lines(spark, [f"{tmp_path}/deep"]).collect()] == ['{"text": "kept"}']
    assert files.list_files(spark, [f"{tmp_path}/deep/_kept/x.txt"]).count() == 1
    assert files.list_files(spark, [f"{tmp_path}/empty.txt"]).count() == 1
