"""Column functions against hand-computed values."""

import json

import pytest
from pyspark.sql import functions as F

from memoloom.functions import prompts
from memoloom.functions.entries import epoch_millis, materialize, normalize_entries, parse_entries
from memoloom.functions.hits import normalize_hits
from memoloom.functions.ranges import filter_numbers, range_members
from memoloom.functions.replies import parse_verdict, response_text
from memoloom.functions.scopes import infer_category, path_user, user_scope, visible_scopes
from memoloom.functions.text import WHITESPACE, explode_lines, strip, unfence
from memoloom.operators.context import contexts, three_decimals, transcript_parts, transcripts

FENCE = "```"


def values(spark, expression, inputs):
    """The expression over a column `x` of strings, in order."""
    df = spark.createDataFrame(list(enumerate(inputs)), "n int, x string")
    return [r["y"] for r in df.select("n", expression.alias("y")).orderBy("n").collect()]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip(spark):
    texts = [WHITESPACE + "a b" + WHITESPACE, "a", "", " \n", None, "é", "﻿a "]
    assert values(spark, strip("x"), texts) == [None if t is None else t.strip() for t in texts]


def test_lines(spark):
    text = "a\r\n b \x0b c\x1e\x85\n\nd\x0ce"
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "n int, text string")
    want = sorted(line.strip() for line in text.splitlines() if line.strip())
    assert sorted(r["line"] for r in explode_lines(df).collect()) == want


def test_unfence(spark):
    cases = {
        f"{FENCE}json\n[1]\n{FENCE}": "[1]",
        f"  {FENCE}\r\n[1,\r\n2]\r\n{FENCE}  ": "[1,\n2]",
        f"{FENCE}[1]{FENCE}": f"{FENCE}[1]{FENCE}",
        f"{FENCE}\n{FENCE}": f"{FENCE}\n{FENCE}",
        f"{FENCE}\n\n{FENCE}": "",
        " plain ": "plain",
        "": "",
    }
    assert values(spark, unfence("x"), list(cases)) == list(cases.values())


def entries_of(spark, reply, user=None):
    expression = F.to_json(parse_entries("x", F.lit("p"), None if user is None else F.lit(user)), {"ignoreNullFields": "false"})
    return json.loads(values(spark, expression, [reply])[0])


def test_parse_entries(spark):
    reply = json.dumps([{"text": "a", "importance": 0.9, "metadata": {"k": [1]}}, 5, None, "x", {"text": 7}])
    first, second = entries_of(spark, f"{FENCE}\n{reply}\n{FENCE}")
    assert (first["text"], first["importance"], json.loads(first["metadata"])) == ("a", 0.9, {"k": [1], "source_path": "p"})
    assert (second["text"], second["category"], json.loads(second["metadata"])) == ("7", None, {"source_path": "p"})


def test_parse_entries_replaces_path_and_scope(spark):
    reply = '[{"text": "a", "scope": "global", "metadata": {"source_path": "other"}}]'
    (entry,) = entries_of(spark, reply, user="u1")
    assert entry["scope"] == "user:u1" and json.loads(entry["metadata"]) == {"source_path": "p"}
    assert entries_of(spark, reply, user="")[0]["scope"] == "global"


@pytest.mark.parametrize("metadata, want", [("null", {}), ("[]", {}), ('"m"', {"metadata_raw": "m"}), ("3", {"metadata_raw": 3})])
def test_parse_entries_keeps_odd_metadata(spark, metadata, want):
    (entry,) = entries_of(spark, f'[{{"text": "a", "metadata": {metadata}}}]')
    assert json.loads(entry["metadata"]) == want | {"source_path": "p"}


@pytest.mark.parametrize("reply", ["", "no json", '{"text": "a"}', "[", "5", "[1, 2]"])
def test_parse_entries_of_unusable_replies(spark, reply):
    assert entries_of(spark, reply) == []


def test_parse_entries_of_null(spark):
    assert values(spark, F.size(parse_entries("x", F.lit("p"))), [None]) == [0]


@pytest.mark.parametrize(
    "reply, want",
    [
        ('{"label": "correct", "reasoning": "r"}', ("correct", "r", 1.0)),
        (f'{FENCE}json\n{{"label": " WRONG ", "score": 1}}\n{FENCE}', (" WRONG ", None, 0.0)),
        ('{"label": "PARTLY", "score": 0.25}', ("PARTLY", None, 0.25)),
        ('{"label": "PARTLY", "score": "0.25"}', ("PARTLY", None, None)),
        ('{"reasoning": "r"}', (None, "r", None)),
        ("[1]", ("WRONG", "Invalid JSON: [1]", 0.0)),
        (" nothing ", ("ERROR", "JSON Decode Error:  nothing ", 0.0)),
        ("", ("ERROR", "JSON Decode Error: ", 0.0)),
    ],
)
def test_parse_verdict(spark, reply, want):
    (got,) = values(spark, parse_verdict("x"), [reply])
    assert (got["label"], got["reasoning"], got["score"]) == want


def test_response_text(spark):
    def message(*parts):
        return {"type": "message", "content": list(parts)}

    note, answer = {"type": "note", "text": "n"}, {"type": "output_text", "text": "a"}
    cases = [
        ({"output": [{"type": "tool", "text": "t"}, message(note, answer)]}, "a"),
        ({"output": [message(note), {"type": "tool", "text": "t"}]}, "n"),
        ({"output": [{"type": "tool"}, {"type": "tool", "text": "t"}]}, "t"),
        ({"output": [message({"type": "output_text"})]}, ""),
    ]
    assert values(spark, response_text("x"), [json.dumps(c) for c, _ in cases]) == [w for _, w in cases]
    raw = ['{"output": []}', '{"id": 1}', "not json", ""]
    assert values(spark, response_text("x"), raw) == raw


def test_render(spark):
    assert values(spark, prompts.render("{{{x}}} and {x}!", x="x"), ["a", None]) == ["{a} and a!", "{} and !"]
    assert values(spark, prompts.ingest_status("x"), ["é" * 60])[0] == "Ingested via chat. Response: " + "é" * 60
    (request,) = values(spark, prompts.judge_request("x", F.lit("g"), F.lit("{w}")), ["q"])
    assert "Question: q\n" in request and "{w}" in request and '{"label"' in request


@pytest.mark.parametrize(
    "spec, want",
    [("1-4", [1, 2, 3, 4]), ("3", [3]), ("5,1, 3 ,,1", [1, 3, 5]), ("4-2", []), ("2 - 3,3-4", [2, 3, 4]), (",", [])],
)
def test_ranges(spark, spec, want):
    assert values(spark, range_members("x"), [spec]) == [want]
    numbers = spark.range(10).select("id")
    assert sorted(r["id"] for r in filter_numbers(numbers, "id", spec).collect()) == want


@pytest.mark.parametrize("spec", ["all", "ALL", "", None])
def test_ranges_without_restriction(spark, spec):
    assert values(spark, range_members("x"), [spec]) == [None]
    assert filter_numbers(spark.range(10), "id", spec).count() == 10


@pytest.mark.parametrize("spec", ["a", "1-2-3", "1-", "-3"])
def test_ranges_refuse_other_text(spark, spec):
    with pytest.raises(Exception, match="not a number or range"):
        filter_numbers(spark.range(10), "id", spec).collect()


def test_users_and_scopes(spark):
    assert values(spark, user_scope("x"), ["u", "", None]) == ["user:u", "global", "global"]
    assert values(spark, visible_scopes("x"), ["u", "", None]) == [["global", "user:u"], None, None]
    assert values(spark, path_user("x"), ["a/b"]) == ["user_a7e86136"]


def test_infer_category(spark):
    cases = {
        "/a/preferences/x.md": "preference",
        "/a/events/Profile.md": "preference",
        "/events/x.md": "fact",
        "/entities/events/x.md": "fact",
        "/a/entities/x.md": "entity",
        "/a/Events/x.md": "other",
        "preferences/x.md": "other",
    }
    assert values(spark, infer_category("x"), list(cases)) == list(cases.values())


def test_epoch_millis(spark):
    assert values(spark, epoch_millis("x"), ["17", "2023-10-01", "soon", None]) == [17, 1696118400000, None, None]


def test_materialize(spark):
    schema = "text string, importance double, scope string, id string, timestamp string, metadata string, source_path string"
    rows = [
        (" a ", 1.5, None, None, None, None, "p"),
        ("b", float("nan"), "", "", "0", '{"k": 1}', "p"),
        ("c", -1.0, "user:u", "id-c", "5", "raw", "p"),
    ]
    got = {r["text"]: r for r in materialize(spark.createDataFrame(rows, schema), 99).collect()}
    assert [got[t]["importance"] for t in "abc"] == [1.0, 1.0, 0.0]
    assert [got[t]["timestamp"] for t in "abc"] == [99, 99, 5] == [got[t]["createdAt"] for t in "abc"]
    assert [got[t]["scope"] for t in "abc"] == ["global", "global", "user:u"]
    assert [got[t]["metadata"] for t in "abc"] == ["{}", '{"k": 1}', "raw"]
    assert got["c"]["id"] == "id-c" and len(got["a"]["id"]) == 36 and got["a"]["id"] != got["b"]["id"]
    again = materialize(spark.createDataFrame(rows, schema), 99).collect()
    assert {r["id"] for r in again} == {r["id"] for r in got.values()}


def test_materialize_refuses_blank_text(spark):
    df = spark.createDataFrame([(" ", 0.5)], "text string, importance double")
    with pytest.raises(Exception, match="must not be blank"):
        materialize(df, 1).collect()


def test_normalize_entries(spark):
    df = spark.createDataFrame([(" a ", None), (None, "0.9"), ("b", "0.9"), ("c", "high")], "text string, importance string")
    got = {r["text"]: (r["category"], r["scope"], r["importance"], r["metadata"]) for r in normalize_entries(df).collect()}
    assert got == {t: ("other", "global", i, "{}") for t, i in (("a", 0.5), ("b", 0.9), ("c", 0.5))}


def test_normalize_hits(spark):
    df = spark.createDataFrame([('{"a": 1}', None, "0.5"), ("raw", "s", "n/a"), (None, "s", None)], "metadata string, scope string, score string")
    rows = normalize_hits(df).select(F.try_variant_get("metadata", "$.a", "int").alias("a"), F.col("metadata").cast("string").alias("m"), "scope", "score").collect()
    assert [(r["a"], r["scope"], r["score"]) for r in rows] == [(1, "global", 0.5), (None, "s", 0.0), (None, "s", 0.0)]
    assert [r["m"] for r in rows] == ['{"a":1}', "raw", None]


def test_three_decimals_round_half_to_even(spark):
    numbers = [0.0625, 0.1875, 0.9995, 1.0, -0.0625, 1234.5]
    df = spark.createDataFrame(list(enumerate(numbers)), "n int, x double")
    got = [r["y"] for r in df.select("n", three_decimals(F.col("x")).alias("y")).orderBy("n").collect()]
    assert got == [f"{x:.3f}" for x in numbers]


def test_contexts(spark):
    schema = "query_id int, rank int, id string, category string, scope string, score double, text string"
    rows = [(1, r, f"m{r}", None, None if r % 2 else "user:u", 1 / r, None if r == 3 else f"t{r}") for r in range(12, 0, -1)]
    (row,) = contexts(spark.createDataFrame(rows, schema)).collect()
    lines = row["context"].split("\n")
    assert lines[0] == "[1] (id=m1, category=other, scope=global, score=1.000) t1"
    assert lines[2] == "[3] (id=m3, category=other, scope=global, score=0.333) "
    assert row["context_ids"] == [f"m{r}" for r in range(1, 13)]


def test_transcripts_of_long_sessions(spark):
    turns = spark.range(5000).select(
        (F.col("id") % 2).alias("s"), F.col("id").alias("turn"), F.lit("a").alias("speaker"), F.col("id").cast("string").alias("text")
    )
    got = {r["s"]: r for r in transcripts(turns.repartition(7), ["s"]).collect()}
    assert got[1]["transcript"] == "\n".join(f"a: {i}" for i in range(1, 5000, 2))
    assert got[0]["turns"] == 2500


def test_parts_of_long_sessions(spark):
    turns = spark.range(2500).select(
        F.lit(1).alias("s"), F.col("id").alias("turn"), F.lit("a").alias("speaker"), F.col("id").cast("string").alias("text"), F.lit("May").alias("d")
    )
    got = {r["part"]: r for r in transcript_parts(turns, ["s"], date="d").collect()}
    assert [got[p]["turns"] for p in (0, 1, 2)] == [1024, 1024, 452]
    assert got[0]["transcript"].startswith("[Session Date: May]\na: 0\n") and got[1]["transcript"].startswith("a: 1024\n")


def test_transcript_defaults(spark):
    turns = spark.createDataFrame([(1, 0, None, "hi", ""), (1, 1, "b", None, ""), (2, 0, "a", "x", "May")], "s int, turn int, speaker string, text string, d string")
    got = {r["s"]: r["transcript"] for r in transcripts(turns, ["s"], date="d").collect()}
    assert got == {1: "Unknown: hi\nb: ", 2: "[Session Date: May]\na: x"}
