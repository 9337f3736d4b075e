"""The pipeline on the smallest tables with planted cases: every stage against plain code on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import test_contamination
import test_repeats
from conftest import plan_of
from memoloom.workspace import materialized
from test_near_copies import plain_components

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = docs.where("doc_id = 2").first()["text"]
    passage = "This closing passage stands word for word in two of the documents, and it is long enough to be found there."
    planted = [
        (9001, "A calm text about rivers and their banks. " * 3 + passage),
        (9002, "Another one, on mountains seen from afar in the morning. " * 2 + passage),
        (9003, clean),
        (9004, "Before the leak there are a few words. " + item + " And some words after it."),
        (9005, "BUY!! NOW!! CHEAP!! " * 30),
        (9006, None),
        (9007, ""),
        (None, "No id, an ordinary line of text."),
    ]
    extra = spark.createDataFrame([(i, t, "en", "p", len(t or "")) for i, t in planted], docs.schema)
    frames = [docs.unionByName(extra)]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialized(stage(spark, frames[-1], SF_DIR), "stage"))
    return frames


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").where("doc_id is not null").collect())


def test_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[:-1])
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(stages[-1].columns)


def test_quality(spark, stages):
    kept = set(ids(stages[1]))
    assert 9005 not in kept and {9001, 9002, 9003, 9004} <= kept
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1")
    good = [r["doc_id"] for r in labels.collect()]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_near_copies(stages):
    want = plain_components(rows(stages[1]))
    assert ids(stages[2]) == sorted(i for i, c in want.items() if i == c)
    assert 9003 not in ids(stages[2])


def test_repeats_are_cut(stages):
    before = [r for r in rows(stages[2])]
    want = {r[0]: r for r in test_repeats.plain(before)}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    for i, text in before:
        _, size, gone, _, _ = want[i]
        if gone == 0:
            assert after[i]["text"] == text
        elif gone < size:
            assert len(after[i]["text"].encode()) >= size - gone and after[i]["n_chars"] == len(after[i]["text"])
        else:
            assert i not in after
    assert "closing passage" not in after[9002]["text"] and "closing passage" in after[9001]["text"]


def test_texts_are_sent_once_to_be_cut(spark, stages, monkeypatch):
    """Marks come to the texts in one shuffle; cut texts are not written and joined to the documents again."""
    written = []
    monkeypatch.setattr(corpus_pipeline, "materialized", lambda df, name: written.append(name) or materialized(df, name))
    plan = plan_of(corpus_pipeline.cut_repeats(spark, stages[2], SF_DIR))
    assert written == [] and plan.count("Join") == 1
    empty = {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"]) for r in stages[3].where("doc_id is null or doc_id in (9006, 9007)").collect()}
    assert all(empty[r["doc_id"]] == (r["text"], r["lang"], r["source"], None if r["text"] is None else len(r["text"])) for r in stages[2].where("doc_id is null or doc_id in (9006, 9007)").collect())


def test_leaks_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(r[0] for r in test_contamination.plain(rows(stages[3]), items) if not r[5] and r[0] is not None)
    assert ids(stages[4]) == want and 9004 not in want


def test_packed(stages):
    assert set(ids(stages[5])) == set(ids(stages[4]))
    sizes = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r["n"] <= 2048 for r in sizes)


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
