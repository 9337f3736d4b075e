"""A model is called once per row, whatever stands around the call; vectors that are not finite cost their own row only."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from memoloom.operators import inference
from memoloom.operators.embedding import ModelEmbedder
from memoloom.operators.inference import ModelCalls
from memoloom.operators.search import search_batch
from memoloom.operators.similarity import knn_join
from memoloom.plans import jobs
from memoloom.sources import memory_table


def counting(folder, reply):
    """A client that leaves one file per call in a folder."""

    def make():
        import uuid
        from pathlib import Path

        def call(sent):
            (Path(folder) / uuid.uuid4().hex).touch()
            return reply

        return call

    return make


def nodes(df, name):
    return plan_of(df).count(name)


def test_one_call_per_text_of_an_ingest(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    texts = spark.range(200).select(F.concat(F.lit("text "), "id").alias("text"), F.col("id").cast("string").alias("path"), F.lit("u").alias("user_id"))
    provider = ModelCalls(counting(str(tmp_path / "calls"), '[{"text": "a"}, {"text": "b"}]'))
    stored = jobs.run_ingest(texts, provider, str(tmp_path / "table"), jobs_embedder(), 1)
    assert stored == 400 and len(list((tmp_path / "calls").iterdir())) == 200


def jobs_embedder():
    from memoloom.operators.embedding import HashEmbedder

    return HashEmbedder(8)


def test_one_embedding_per_query(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import uuid
        from pathlib import Path

        def predict(texts):
            for _ in texts:
                (Path(folder) / uuid.uuid4().hex).touch()
            return np.array([[float(len(t)), 1.0] for t in texts], np.float32)

        return predict

    questions = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("q"), "id").alias("query"))
    memories = spark.createDataFrame([(str(i), [float(i), 1.0], "global", "t") for i in range(9)], "id string, vector array<float>, scope string, text string")
    hits = search_batch(questions, memories, ModelEmbedder(load, 2), top_k=2, min_score=None)
    assert hits.count() == 80
    assert len(list(tmp_path.iterdir())) == 40


def test_filters_do_not_repeat_calls(spark):
    provider = ModelCalls(counting("/nowhere", "x"))
    rows = spark.createDataFrame([("q", "g", "a", "t", "p", "u")], "question string, ground_truth string, answer string, text string, path string, user_id string")
    assert nodes(inference.judge(rows, provider).where("judge_result.score < 1"), "ArrowEvalPython") == 1
    assert nodes(inference.agent_answer(rows.drop("answer"), provider).where("answer = 'x'"), "ArrowEvalPython") == 1
    assert nodes(inference.extract(rows, provider).select(F.explode("entries")), "ArrowEvalPython") == 1


BAD = [[math.nan, 0.0], [None, 0.0], [math.inf, 1.0], [-math.inf, 1.0], None]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_bad_vectors_cost_their_own_row(spark, metric):
    good = [(f"g{i:02}", [float(i), 1.0]) for i in range(50)]
    schema = "id string, vector array<float>"
    asked = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(3)] + [(9, [math.nan, 1.0])], "query_id long, vector array<float>")

    def hits(rows):
        found = knn_join(asked, spark.createDataFrame(rows, schema).coalesce(1), k=5, min_score=None, metric=metric)
        return sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect())

    clean = hits(good)
    assert len(clean) == 15
    assert hits(good + [(f"b{i}", v) for i, v in enumerate(BAD)]) == clean


@pytest.mark.parametrize("vector", BAD)
def test_append_refuses_bad_vectors(spark, tmp_path, vector):
    path = str(tmp_path / "t")
    memory_table.create_table(spark, path, 2, "basic")
    rows = spark.createDataFrame([("a", "t", vector, "c", 0.5, 1)], "id string, text string, vector array<float>, category string, importance double, createdAt long")
    with pytest.raises(Exception, match="vector"):
        memory_table.append(rows, path)
