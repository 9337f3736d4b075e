"""Jobs that are repeated or fail half way: replies are kept, appended rows come once."""

import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from memoloom.operators import inference
from memoloom.operators.embedding import CachedEmbedder, HashEmbedder, ModelEmbedder, embed
from memoloom.operators.inference import LoggedCalls, ModelCalls
from memoloom.plans import jobs
from memoloom.sources import json_array, memory_table


def client_of(folder, fail_after=None, refuse=()):
    """A client that leaves a file per call; new clients fail once there are `fail_after` calls, requests in `refuse` always."""

    def make():
        if fail_after is not None and len(list(Path(folder).iterdir())) >= fail_after:
            raise RuntimeError("service gone")

        def call(sent):
            if sent["request"] in refuse:
                raise ValueError("refused")
            (Path(folder) / uuid.uuid4().hex).write_text(sent["request"])
            return f"{sent['system']}|{sent['request']}|{sent['user']}"

        return call

    return make


def asked(folder):
    return sorted(p.read_text() for p in folder.iterdir())


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def questions(spark, n=60, different=40):
    rows = spark.range(n).select("id", F.concat(F.lit("q"), F.col("id") % different).alias("q"))
    return rows.withColumn("q", F.when(F.col("id") != 0, F.col("q")))


def test_a_failed_job_asks_only_for_the_rest(spark, tmp_path, calls):
    rows, log = questions(spark), str(tmp_path / "log")
    with pytest.raises(Exception, match="service gone"):
        inference.infer(rows, LoggedCalls(ModelCalls(client_of(calls, fail_after=15)), log, slice_rows=10, at_once=1), F.col("q"), system="s")
    before = asked(calls)
    assert 15 <= len(before) < 40 and len(set(before)) == len(before)
    out = inference.infer(rows, LoggedCalls(ModelCalls(client_of(calls)), log), F.col("q"), system="s")
    got = {r["id"]: (r["response"], r["error"]) for r in out.collect()}
    assert got == {i: (f"s|q{i % 40}|None" if i else None, None) for i in range(60)}
    assert asked(calls) == sorted(f"q{i}" for i in range(40))  # nothing asked twice; row 0 asks nothing, row 40 asks q0
    again = inference.infer(rows, LoggedCalls(ModelCalls(client_of(calls, fail_after=0)), log), F.col("q"), system="s")
    assert {r["id"]: (r["response"], r["error"]) for r in again.collect()} == got


def test_failed_calls_are_asked_again_and_settings_tell_requests_apart(spark, tmp_path, calls):
    rows, log = spark.createDataFrame([(1, "a", None), (2, "b", ""), (3, "b", "u")], "id int, q string, u string"), str(tmp_path / "log")

    def run(refuse=(), **options):
        out = inference.infer(rows, LoggedCalls(ModelCalls(client_of(calls, refuse=refuse)), log), F.col("q"), user=F.col("u"), **options)
        return {r["id"]: (r["response"], r["error"]) for r in out.collect()}

    assert run(refuse=("a",)) == {1: (None, "refused"), 2: ("|b|", None), 3: ("|b|u", None)}
    assert run() == {1: ("|a|None", None), 2: ("|b|", None), 3: ("|b|u", None)}
    assert len(asked(calls)) == 3
    run(params={"temperature": 1})
    run(system="t")
    assert len(asked(calls)) == 9


def test_limit_of_calls_at_a_time():
    def shape(at_once, threads, cores):
        return LoggedCalls(ModelCalls(None, threads=threads), "", at_once=at_once).shape(cores)

    assert shape(None, 4, 100) == (100, 4)
    for at_once in range(1, 40):
        tasks, threads = shape(at_once, 4, 8)
        assert 1 <= tasks * threads <= at_once and tasks <= 8
    with pytest.raises(ValueError, match="at_once"):
        shape(0, 4, 8)


def test_calls_at_a_time_in_a_run(spark, tmp_path, calls):
    running = tmp_path / "running"
    running.mkdir()

    def make():
        def call(sent):
            import time

            own = running / uuid.uuid4().hex
            own.touch()
            time.sleep(0.05)
            (calls / uuid.uuid4().hex).write_text(str(len(list(running.iterdir()))))
            own.unlink()
            return "r"

        return call

    provider = LoggedCalls(ModelCalls(make, threads=2), str(tmp_path / "log"), slice_rows=30, at_once=3)
    assert inference.infer(questions(spark), provider, F.col("q")).where("response = 'r'").count() == 59
    assert len(asked(calls)) == 40 and max(int(n) for n in asked(calls)) <= 3


def test_the_five_uses_take_logged_calls(spark, tmp_path, calls):
    provider = LoggedCalls(ModelCalls(client_of(calls)), str(tmp_path / "log"))
    rows = spark.createDataFrame([("q", "g", "a", "t", "p", "u")], "question string, ground_truth string, answer string, text string, path string, user_id string")
    for _ in range(2):
        assert inference.judge(rows, provider).count() == 1
        assert inference.answer(rows.drop("answer").withColumn("context", F.lit("c")), provider).first()["answer"].endswith("None")
        assert inference.extract(rows, provider).count() == 1
        assert inference.agent_answer(rows.drop("answer"), provider).count() == 1
        assert inference.agent_ingest(rows, provider).count() == 1
    assert len(asked(calls)) == 5


# ---------------------------------------------------------------------------------------------- vectors


def lengths_of(folder, fail_after=None):
    """A model that leaves a file per text; new workers fail once there are `fail_after`."""

    def load():
        import numpy as np

        if fail_after is not None and len(list(Path(folder).iterdir())) >= fail_after:
            raise RuntimeError("no model")

        def predict(texts):
            for text in texts:
                (Path(folder) / uuid.uuid4().hex).write_text(text)
            return np.array([[float(len(t)), 1.0] for t in texts], np.float32)

        return predict

    return load


def test_vectors_are_kept(spark, tmp_path, calls):
    def cache(model="m", **options):
        slices = {"slice_rows": options.pop("slice_rows")} if "slice_rows" in options else {}
        plain = ModelEmbedder(lengths_of(calls, **options), 2, normalize=False, query_instruction="ask: ")
        return CachedEmbedder(plain, str(tmp_path / "vectors"), model, **slices)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "b", "aa", "", None, "b" * 9, "aa"])], "id int, text string")
    want = {0: [2.0, 1.0], 1: [1.0, 1.0], 2: [2.0, 1.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [9.0, 1.0], 6: [2.0, 1.0]}
    for _ in range(2):
        assert {r["id"]: r["vector"] for r in embed(rows, cache(slice_rows=1)).collect()} == want
        assert asked(calls) == ["aa", "b", "b" * 9]
    assert {r["id"]: r["vector"] for r in embed(rows, cache(), query=True).collect()}[1] == [6.0, 1.0]
    assert len(asked(calls)) == 6
    embed(rows, cache("other"))
    assert len(asked(calls)) == 9
    assert embed(rows.where("id < 0"), cache()).count() == 0 and len(asked(calls)) == 9
    with pytest.raises(Exception, match="no model"):
        embed(rows.withColumn("text", F.lit("new")), cache(fail_after=0))


def test_a_second_import_embeds_nothing(spark, tmp_path, calls):
    (tmp_path / "in").mkdir()
    for name in "abc":
        (tmp_path / "in" / f"{name}.txt").write_text(f"note {name}")
    for run in ("1", "2"):
        embedder = CachedEmbedder(ModelEmbedder(lengths_of(calls), 2), str(tmp_path / "vectors"), "m")
        assert jobs.run_import(spark, [str(tmp_path / "in")], str(tmp_path / run), embedder, 1) == 3
    assert asked(calls) == ["note a", "note b", "note c"]


# ---------------------------------------------------------------------------------------------- keyed tables


def entries(spark, n, text="t", vector=(1.0, 0.0)):
    rows = [(f"i{i}", text, list(vector), "fact", 0.5, 7, 7, "global", "{}") for i in range(n)]
    names = "id string, text string, vector array<double>, category string, importance double"
    return spark.createDataFrame(rows, names + ", timestamp long, createdAt long, scope string, metadata string")


@pytest.mark.parametrize("mode", ["pro", "basic"])
def test_append_twice_with_one_key_is_once(spark, tmp_path, mode):
    path = str(tmp_path / "m")
    empty = memory_table.create_table(spark, path, 2, mode, keyed=True)
    assert empty.count() == 0 and "run" not in empty.columns and memory_table.table_dimension(empty) == 2
    assert memory_table.append(entries(spark, 5), path, "2026/a=b") == 5
    assert memory_table.append(entries(spark, 5), path, "2026/a=b") == 5
    assert memory_table.append(entries(spark, 3, "other"), path, "7") == 3
    table = memory_table.open_table(spark, path)
    assert table.count() == 8 and memory_table.table_mode(table) == mode
    assert memory_table.append(entries(spark, 2, "new"), path, "2026/a=b") == 2
    assert sorted(r["text"] for r in memory_table.open_table(spark, path).collect()) == ["new"] * 2 + ["other"] * 3


def test_a_failing_append_leaves_the_earlier_rows(spark, tmp_path):
    path = str(tmp_path / "m")
    memory_table.create_table(spark, path, 2, keyed=True)
    memory_table.append(entries(spark, 4, "old"), path, "k")
    half = entries(spark, 50, "half").union(entries(spark, 1, "bad", (1.0,))).repartition(8)
    for key in ("k", "l"):
        with pytest.raises(Exception, match="vector dimension mismatch"):
            memory_table.append(half, path, key)
    assert [r["text"] for r in memory_table.open_table(spark, path).collect()] == ["old"] * 4


def test_keys_belong_to_keyed_tables(spark, tmp_path):
    plain, keyed = str(tmp_path / "p"), str(tmp_path / "k")
    memory_table.create_table(spark, plain, 2)
    memory_table.create_table(spark, keyed, 2, keyed=True)
    for path, key in ((plain, "a"), (keyed, None), (keyed, ""), (keyed, memory_table.CREATED)):
        with pytest.raises(ValueError, match="run key"):
            memory_table.append(entries(spark, 1), path, key)


def test_a_repeated_import_gives_its_rows_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("note")
    path, embedder = str(tmp_path / "m"), HashEmbedder(8)
    for _ in range(2):
        assert jobs.run_import(spark, [str(tmp_path / "in")], path, embedder, 1, run_key="day 1") == 1
    assert memory_table.open_table(spark, path).count() == 1


# ---------------------------------------------------------------------------------------------- array sink


def test_written_arrays_are_whole_files(spark, tmp_path):
    import json

    rows = spark.range(100, numPartitions=4).where("id < 60").select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("a"), F.lit('x\n"]').alias("b"))
    path = str(tmp_path / "out")
    json_array.write_json_arrays(rows, path)
    files = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sorted(len(f) for f in files) == [0, 10, 25, 25] and all("a" in item for f in files for item in f)
    back = json_array.read_json_array(spark, [path], rows.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception, match="already exists"):
        json_array.write_json_arrays(rows, path)
