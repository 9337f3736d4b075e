"""Model calls: retries, failures and the values each use reports for them."""

import json
import time
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memoloom.functions import prompts
from memoloom.operators import inference
from memoloom.operators.inference import DryRun, ModelCalls, ModelError, ResponsesTable, Retry


class Flaky:
    """Fails as told, then answers."""

    def __init__(self, *errors):
        self.errors = list(errors)

    def __call__(self, sent):
        if self.errors:
            raise self.errors.pop(0)
        return f"ok {sent}"


def attempt(*errors, attempts=5):
    waits = []
    try:
        return Retry(attempts, 2.0).call(Flaky(*errors), "x", sleep=waits.append), waits
    except Exception as error:
        return str(error), waits


def test_retry_waits_and_doubles():
    busy = [ModelError(500), ModelError(429), ConnectionError("gone"), TimeoutError("late")]
    assert attempt(*busy) == ("ok x", [2.0, 4.0, 8.0, 16.0])


def test_retry_gives_up_after_the_last_attempt():
    assert attempt(*[ModelError(503)] * 5) == ("status 503", [2.0, 4.0, 8.0, 16.0])


@pytest.mark.parametrize("error", [ModelError(404), ModelError(400), ValueError("status 404")])
def test_other_errors_are_final(error):
    assert attempt(error) == (str(error), [])


def test_single_attempt():
    assert attempt(ModelError(500), attempts=1) == ("status 500", [])


@pytest.fixture
def items(spark):
    rows = [(1, "good", "c", "g", "a", "u"), (2, "bad", "c", "g", "a", ""), (3, "", None, None, None, None)]
    return spark.createDataFrame(rows, "n int, question string, context string, ground_truth string, answer string, user_id string")


def failing(reply):
    """A provider that refuses requests holding 'bad' and gives `reply` for others."""

    def make_client():
        def call(sent):
            if "bad" in sent["request"]:
                raise ModelError(400, "refused")
            return reply(sent)

        return call

    return ModelCalls(make_client)


def column(df, name):
    return [r[name] for r in df.orderBy("n").collect()]


def test_answer(spark, items):
    given = inference.answer(items, failing(lambda sent: sent["request"].upper()))
    assert column(given, "answer") == [
        "QUESTION: GOOD\n\nRELATED MEMORIES:\nC",
        "Error generating answer",
        "QUESTION: \n\nRELATED MEMORIES:\n",
    ]
    assert given.columns == items.columns  # `answer` replaced, nothing else added


def test_answer_gets_parameters(spark, items):
    def reply(sent):
        return json.dumps({k: sent[k] for k in ("temperature", "max_tokens", "system")})

    given = json.loads(column(inference.answer(items, failing(reply), system="s"), "answer")[0])
    assert given == {"temperature": 0.2, "max_tokens": 512, "system": "s"}


def test_judge(spark, items):
    judged = column(inference.judge(items, failing(lambda sent: '{"label": "WRONG", "reasoning": "r"}')), "judge_result")
    assert [tuple(j) for j in judged] == [("WRONG", "r", 0.0), ("ERROR", "Error: refused", 0.0), ("WRONG", "r", 0.0)]


def test_extract(spark):
    texts = spark.createDataFrame([(1, "good", "d/x.md", "u"), (2, "bad", None, None), (3, None, "y", None)], "n int, text string, path string, user_id string")
    found = column(inference.extract(texts, failing(lambda sent: '[{"text": "m"}]')), "entries")
    assert [[(e["text"], e["scope"]) for e in entries] for entries in found] == [[("m", "user:u")], [], []]
    dry = column(inference.extract(texts, DryRun()), "entries")
    assert [(e[0]["text"], e[0]["scope"]) for e in dry] == [
        ("Dry-run memory from x.md", "user:u"),
        ("Dry-run memory from unknown", "global"),
        ("Dry-run memory from y", "global"),
    ]


def test_agent_answer(spark, items):
    def reply(sent):
        return json.dumps({"output": [{"type": "message", "content": [{"type": "output_text", "text": f"for {sent['user']}"}]}]})

    assert column(inference.agent_answer(items, failing(reply)), "answer") == ["for u", "Error: refused", ""]
    dry = inference.agent_answer(items, DryRun(), agent="helper")
    assert column(dry, "answer")[0] == "Dry-run helper answer to: good"


def test_agent_answer_retries(spark, items):
    def make_client():
        failed = set()

        def call(sent):
            if sent["request"] not in failed:
                failed.add(sent["request"])
                raise ModelError(502)
            return "raw"

        return call

    patient = inference.agent_answer(items, ModelCalls(make_client), retry=Retry(2, 0.0))
    assert column(patient, "answer") == ["raw", "raw", ""]
    hasty = inference.agent_answer(items, ModelCalls(make_client), retry=Retry(1, 0.0))
    assert column(hasty, "answer") == ["Error: status 502", "Error: status 502", ""]


def test_agent_ingest(spark):
    texts = spark.createDataFrame([(1, "good", "a/b", None), (2, "", "p", None), (3, "bad", "p", "u")], "n int, text string, path string, user_id string")
    told = column(inference.agent_ingest(texts, failing(lambda sent: sent["user"] + " " * 60)), "agent_response")
    assert told == [
        "Ingested via chat. Response: user_a7e86136" + " " * 60,
        "Skipped: empty text",
        "Error: refused",
    ]
    assert column(inference.agent_ingest(texts, DryRun()), "agent_response")[0] == "Dry-run ingest: a/b"


def test_responses_table(spark, items):
    request = prompts.answer_request("question", "context")
    known = items.where("n = 1").select(
        inference.request_hash(request, F.lit("s")).alias("request_hash"), F.lit("stored").alias("response")
    )
    given = inference.answer(items, ResponsesTable(known), system="s")
    assert column(given, "answer") == ["stored", "Error generating answer", "Error generating answer"]


def test_client_is_made_once_per_task(spark):
    def make_client():
        made = []

        def call(sent):
            made.append(sent)
            return str(len(made))

        return call

    df = spark.range(30000).coalesce(1).select("id", F.col("id").cast("string").alias("r"))
    called = inference.infer(df, ModelCalls(make_client, threads=1), F.col("r"))
    assert called.agg(F.max(F.col("response").cast("int"))).first()[0] == 30000


def test_missing_columns_count_as_empty(spark):
    df = spark.createDataFrame([("q",)], "question string")
    assert inference.answer(df, failing(lambda sent: sent["request"])).first()["answer"] == "Question: q\n\nRelated Memories:\n"
    assert inference.judge(df, DryRun()).first()["judge_result"]["label"] == "CORRECT"


def test_few_requests_and_replies_are_held_at_a_time():
    """A task takes rows as replies leave, not a whole batch of requests before the first reply."""
    taken, most = 0, 0
    batch = pa.array([{"request": "r" * 50, "user": None}] * 20_000, pa.struct([("request", pa.string()), ("user", pa.string())]))

    def rows():
        nonlocal taken
        for row in inference._rows(iter([batch])):
            taken += 1
            yield row

    given = 0
    with ThreadPoolExecutor(4) as pool:
        answered = inference._in_order(pool, lambda row: (row["request"], None), rows(), 256)
        for array in inference._packed(answered):
            given += len(array)
            most = max(most, taken - given + len(array))
            assert array.field("response")[0].as_py() == "r" * 50
    assert given == 20_000 and most <= 256 + 1024


def test_replies_keep_the_order_of_rows_over_batches(spark):
    df = spark.range(3000, numPartitions=1).select("id", F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("r"))

    def make_client():
        def call(sent):
            time.sleep(0.002 if int(sent["request"]) % 97 == 1 else 0)
            return sent["request"] + "x" * (2000 if int(sent["request"]) % 2 else 0)

        return call

    for r in inference.infer(df, ModelCalls(make_client, threads=8), F.col("r")).collect():
        assert r["error"] is None and (r["response"] or "").rstrip("x") == (r["r"] or "")
