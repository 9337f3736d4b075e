"""Quality scores: the discriminant against NumPy, held-out accuracy on the supplied labels, defined results."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memoloom.llm import quality

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    return {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()}


def test_every_document_has_a_score(spark, judged):
    rows, _ = judged
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_accuracy(judged):
    rows, labels = judged
    held = [(rows[i]["predicted"], q) for i, q in labels.items() if rows[i]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    good, bad = ([rows[i]["score"] for i, q in labels.items() if rows[i]["held_out"] and q == want] for want in (1, 0))
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert above >= 0.98 * len(good) * len(bad)


def test_score_is_the_discriminant(spark):
    rng = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    data = [(rng.normal(0, 1, d).tolist(), 0) for _ in range(80)] + [(rng.normal(0.5, 2, d).tolist(), 1) for _ in range(120)]
    rows = spark.createDataFrame(data, "statistics array<double>, label int")
    model = quality.fit(rows, shrinkage=0.2)
    got = rows.select("statistics", model.score(F.col("statistics")).alias("s")).collect()
    x = {k: np.array([v for v, label in data if label == k]) for k in (0, 1)}
    spread = {k: np.cov(x[k].T, bias=True) for k in x}
    pooled = (80 * spread[0] + 120 * spread[1]) / 200

    def density(v, k):
        cov = 0.8 * spread[k] + 0.2 * np.diag(np.diag(0.5 * spread[k] + 0.5 * pooled)) + 1e-4 * np.eye(d)
        gap = v - x[k].mean(0)
        return math.log(len(x[k]) / 200) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * gap @ np.linalg.solve(cov, gap)

    for r in got:
        v = np.array(r["statistics"])
        assert r["s"] == pytest.approx(1 / (1 + math.exp(density(v, 0) - density(v, 1))), abs=1e-6)


def test_defined_results(spark):
    texts = [(i, "A calm and ordinary line of text, as people write it. " * (1 + i % 5)) for i in range(40)]
    texts += [(100 + i, "SHOUT!! NOW!! " * (5 + i)) for i in range(20)]
    texts += [(500, None), (501, ""), (None, "no id"), (502, "long " * 300_000), (3, "twice"), (3, "twice"), (503, "\x00�日本")]
    docs = spark.createDataFrame([(*r, "en", 0.5, 7) for r in texts], "doc_id long, text string, lang string, score double, statistics long")
    rows = [(i, int(i < 100)) for i, _ in texts[:60]] + [(500, None), (None, 1), (5, 1), (5, 1)]
    labels = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, quality int, statistics int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    one = quality.classify(docs, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one} == {1.0}
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).collect() == []
