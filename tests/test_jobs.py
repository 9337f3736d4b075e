"""The composed jobs over small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from memoloom.operators import grading
from memoloom.operators.embedding import HashEmbedder
from memoloom.operators.inference import DryRun, ModelCalls
from memoloom.operators.lookup import lookup
from memoloom.operators.search import align, attach_payload, search_batch, search_one, search_vectors
from memoloom.plans import jobs
from memoloom.schemas import JUDGED_RESULT
from memoloom.sources.json_array import write_results
from memoloom.workspace import run_folder, shared_folder

NOW = 1_700_000_000_000
EMBEDDER = HashEmbedder(16)


@pytest.fixture
def inbox(tmp_path):
    root = tmp_path / "in"
    (root / "preferences").mkdir(parents=True)
    (root / "preferences" / "tea.md").write_text("likes tea\n")
    (root / "lines.jsonl").write_text('{"text": "a", "scope": "user:u"}\n{"text": "b", "id": "b1"}\nbroken\n')
    (root / "result_3.json").write_text(json.dumps([{"question": "q", "ground_truth": "g", "score": 1.0}]))
    (root / "plain.log").write_text("plain")
    return str(root)


def test_import_by_suffix(spark, inbox, tmp_path):
    path = str(tmp_path / "m")
    assert jobs.run_import(spark, [inbox], path, EMBEDDER, NOW) == 5
    rows = {r["text"]: r for r in spark.read.parquet(path).collect()}
    assert rows["likes tea"]["category"] == "preference" and rows["likes tea"]["importance"] == 0.8
    assert rows["a"]["scope"] == "user:u" and rows["b"]["id"] == "b1" and rows["plain"]["importance"] == 0.6
    assert "Graded item None of R3 (?). Question: q Ground Truth: g" in "".join(rows)
    assert all(r["timestamp"] == NOW and len(r["vector"]) == 16 for r in rows.values())


def test_import_again_gives_equal_ids(spark, inbox, tmp_path):
    path = str(tmp_path / "m")
    jobs.run_import(spark, [inbox], path, EMBEDDER, NOW)
    jobs.run_import(spark, [inbox], path, EMBEDDER, NOW)
    counts = spark.read.parquet(path).groupBy("id").count().collect()
    assert len(counts) == 5 and all(r["count"] == 2 for r in counts)


def test_import_in_one_format(spark, inbox, tmp_path):
    assert jobs.run_import(spark, [inbox], str(tmp_path / "t"), EMBEDDER, NOW, input_format="text") == 4
    with pytest.raises(ValueError):
        jobs.run_import(spark, [inbox], str(tmp_path / "t"), EMBEDDER, NOW, input_format="pdf")


def test_import_of_nothing(spark, tmp_path):
    assert jobs.run_import(spark, [str(tmp_path / "missing")], str(tmp_path / "m"), EMBEDDER, NOW) == 0


def test_auto_import_opens_each_file_once(spark, inbox):
    payloads = jobs.import_payloads(spark, [inbox])
    payloads.collect()
    metrics = []

    def walk(node):
        if "FileScan" in node.nodeName() or "Scan " in node.nodeName():
            metrics.append(node.metrics().apply("numFiles").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(payloads._jdf.queryExecution().executedPlan())
    assert sum(metrics) == 4  # one scan per format, each over its own file


@pytest.fixture
def memories(spark, tmp_path):
    path = str(tmp_path / "stored")
    texts = ["tea", "coffee", "milk", "bread"]
    rows = [(t, "user:u" if t == "milk" else "global", "fact", 0.5, json.dumps({"t": t})) for t in texts]
    payloads = spark.createDataFrame(rows, "text string, scope string, category string, importance double, metadata string")
    jobs.store(payloads, EMBEDDER, path, NOW)
    return spark.read.parquet(path)


def test_search_finds_the_same_text(spark, memories):
    (hit,) = search_one(" tea ", memories, EMBEDDER, top_k=1).collect()
    assert hit["text"] == "tea" and hit["rank"] == 1 and abs(hit["score"] - 1.0) < 1e-6
    assert search_one(" ", memories, EMBEDDER).count() == 0


def test_search_batch_keeps_every_query(spark, memories, tmp_path):
    queries = spark.createDataFrame([(0, " milk", "u"), (1, "milk", "v"), (2, " ", "u"), (3, None, None), (4, "milk", None)], "query_id int, query string, user_id string")
    rows = {r["query_id"]: r for r in jobs.run_search(queries, memories, EMBEDDER, min_score=0.9).collect()}
    found = {i: [h["text"] for h in rows[i]["results"]] for i in range(5)}
    assert found == {0: ["milk"], 1: [], 2: [], 3: [], 4: ["milk"]}
    assert rows[0]["query"] == "milk"
    write_results(jobs.run_search(queries, memories, EMBEDDER, min_score=0.9), str(tmp_path / "out"))
    written = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {r["query_id"]: [h["metadata"] for h in r["results"]] for r in written}[0] == [{"t": "milk"}]


def test_basic_tables_count_as_global(spark, tmp_path):
    path = str(tmp_path / "basic")
    payloads = spark.createDataFrame([("tea", "user:u", 0.5)], "text string, scope string, importance double")
    jobs.store(payloads, EMBEDDER, path, NOW, mode="basic")
    queries = spark.createDataFrame([(0, "tea", "other")], "query_id int, query string, user_id string")
    (hit,) = search_batch(queries, spark.read.parquet(path), EMBEDDER, min_score=0.9).collect()
    assert hit["scope"] == "global"


def test_copies_sharing_an_id_are_shown_once_each(spark):
    memories = spark.createDataFrame([("x", "t", [1.0, 0.0]), ("x", "t", [1.0, 0.0]), ("y", "u", [0.0, 1.0])], "id string, text string, vector array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<float>")
    hits = search_vectors(queries, memories, min_score=None)
    shown = attach_payload(hits, memories).orderBy("rank").collect()
    assert [(r["id"], r["text"]) for r in shown] == [("x", "t"), ("x", "t"), ("y", "u")]


def test_align_orders_by_rank(spark):
    hits = spark.createDataFrame([(1, r, f"m{r}") for r in range(12, 0, -1)], "query_id int, rank int, id string")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = {r["query_id"]: [h["id"] for h in r["results"]] for r in align(queries, hits).collect()}
    assert rows == {1: [f"m{r}" for r in range(1, 13)], 2: []}


def test_ingest_and_eval_and_judge(spark, tmp_path):
    path = str(tmp_path / "m")
    texts = spark.createDataFrame([("Ann: tea\nBob: coffee", "s/1", "ann"), ("x", "s/2", None)], "text string, path string, user_id string")

    def make_client():
        def call(sent):
            if sent["request"].startswith("Question"):
                return sent["request"].split(") ")[-1]
            if "Given answer" in sent["request"]:
                same = "Reference answer: Ann: tea\nGiven answer: Ann: tea" in sent["request"]
                return json.dumps({"label": "correct" if same else "wrong"})
            return json.dumps([{"text": line, "importance": 0.9} for line in sent["request"].split("\n")])

        return call

    model = ModelCalls(make_client)
    assert jobs.run_ingest(texts, model, path, EMBEDDER, NOW) == 3
    stored = spark.read.parquet(path)
    assert {(r["text"], r["scope"], r["importance"]) for r in stored.collect()} == {
        ("Ann: tea", "user:ann", 0.9),
        ("Bob: coffee", "user:ann", 0.9),
        ("x", "global", 0.9),
    }
    questions = spark.createDataFrame(
        [("Ann: tea", "Ann: tea", "ann"), ("Bob: coffee", "nothing", "ann"), ("Ann: tea", "Ann: tea", "bob"), ("Ann: tea", "Ann: tea", "ann")],
        "question string, ground_truth string, user_id string",
    )
    answered = jobs.run_eval(questions, stored, EMBEDDER, model, min_score=0.9)
    assert answered.count() == 4  # equal questions are all answered
    judged = jobs.run_judge(answered, model)
    assert judged.accuracy.first()["accuracy"] == 0.5
    assert {(r["user_id"], r["question"]) for r in judged.failures.collect()} == {("ann", "Bob: coffee"), ("bob", "Ann: tea")}
    assert judged.report.first()["correct"] == 2


def test_agent_eval_skips_search(spark):
    questions = spark.createDataFrame([("q", "u")], "question string, user_id string")
    (row,) = jobs.run_eval(questions, None, None, DryRun(), agent=True).collect()
    assert (row["context"], row["context_ids"], row["answer"]) == ("", [], "Dry-run agent answer to: q")
    texts = spark.createDataFrame([("t", "p")], "text string, path string")
    assert jobs.run_agent_ingest(texts, DryRun()).collect()[0]["agent_response"] == "Dry-run ingest: p"


def test_lookup_spreads_hot_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None)], "id long, k string"))
    table = rows.where("k is not null").select("k", F.concat(F.lit("v-"), "k").alias("v")).distinct().where("k <> '4'")
    for how in ("inner", "left"):
        plain = rows.join(table, "k", how).select("id", "k", "v")
        spread = lookup(rows, table, "k", F.xxhash64("id"), how, rows_per_part=10).select("id", "k", "v")
        assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, spread.collect()), key=repr)


def test_shared_folder():
    class Session:
        def __init__(self, **settings):
            self.settings = {k.replace("_", "."): v for k, v in settings.items()}
            self.conf = self

        def get(self, key, default):
            return self.settings.get(key, default)

    assert shared_folder(Session(spark_checkpoint_dir="s3://b/x/")) == "s3://b/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="local[2]"))
    assert run_folder(Session(spark_checkpoint_dir="s3://b/x/", spark_app_id="a")) == "s3://b/x/a"


# ---------------------------------------------------------------------------------------------- reports


def judged(spark, rows):
    full = [{"question": "q", "answer": a, "judge_result": {"label": "L", "reasoning": r, "score": s}} for a, r, s in rows]
    return spark.createDataFrame(full, JUDGED_RESULT)


def test_reports(spark):
    df = judged(spark, [("a", "ok", 1.0), ("500 Internal Server Error", "No gold", 0.0), ("a", "Empty answer", 0.7), (None, None, None), ("a", "no gold", 0.69)])
    report = grading.score_report(df).first()
    assert (report["total"], report["correct"], report["wrong"]) == (5, 2, 3)
    assert (report["server_errors"], report["missing_ground_truth"], report["excluded"]) == (1, 2, 2)
    assert report["adjusted_accuracy"] == 100.0 and abs(report["adjusted_accuracy_distinct"] - 200 / 3) < 1e-9
    accuracy = grading.accuracy(df).first()
    assert abs(accuracy["accuracy"] - 2.39 / 4) < 1e-9 and accuracy["scored"] == 4 and accuracy["failed"] == 3


def test_reports_on_nothing(spark):
    df = judged(spark, [])
    assert grading.accuracy(df).first()["accuracy"] == 0.0
    report = grading.score_report(df).first()
    assert report["total"] == 0 and report["correct_pct"] is None and report["adjusted_accuracy"] is None
    assert grading.failures(df).count() == 0


def test_failures_show_whole_questions(spark):
    rows = [{"question": "x" * n, "user_id": None, "judge_result": {"reasoning": None, "score": 0.0}} for n in (60, 61)]
    got = grading.failures(spark.createDataFrame(rows, JUDGED_RESULT)).collect()
    assert sorted(r["question"] for r in got) == ["x" * 60, "x" * 61]
    assert {(r["user_id"], r["reasoning"]) for r in got} == {("unknown", "No reasoning")}


def test_library_does_not_collect():
    from pathlib import Path

    root = Path(jobs.__file__).resolve().parent.parent
    for file in root.rglob("*.py"):
        if "llm" in file.relative_to(root).parts:  # has its own tests; collects what is bounded by parameters
            continue
        code = file.read_text()
        for word in (".collect()", ".toPandas()", ".toArrow()", ".take(", ".toLocalIterator(", "crossJoin", "localCheckpoint", ".rdd"):
            assert word not in code, (file, word)
