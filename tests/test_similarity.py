"""The similarity join against brute force, in both physical forms and under skew."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from memoloom.operators import regions, similarity
from memoloom.operators.similarity import knn_join, top_k
from memoloom.operators.topk import RunningTopK

DIM = 8


def brute_force(queries: pd.DataFrame, memories: pd.DataFrame, k, min_score, metric):
    """All pairs in numpy, ordered by score and id."""
    out = []
    for _, q in queries.iterrows():
        if q["vector"] is None:
            continue
        hits = []
        for _, m in memories.iterrows():
            if m["vector"] is None or (q["scopes"] is not None and m["scope"] not in q["scopes"]):
                continue
            a, b = np.asarray(q["vector"], np.float32).astype(float), np.asarray(m["vector"], np.float32).astype(float)
            if metric == "l2":
                score = 1.0 - ((a - b) ** 2).sum()
            else:
                norms = np.sqrt((a * a).sum() * (b * b).sum())
                score = (a * b).sum() / norms if norms else 0.0
            if min_score is None or score >= min_score:
                hits.append((-round(score, 9), m["id"]))
        out += [(q["query_id"], i + 1, m, -s) for i, (s, m) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def rows_of(df):
    rows = df.select("query_id", "rank", "id", F.round("score", 9).alias("score")).collect()
    return sorted((r[0], r[1], r[2], r[3] + 0.0) for r in rows)


def assert_same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-8)


def make(spark, nq=40, nm=300, seed=1, hot=0.4, copies=0, users=5):
    """Memories of which `hot` lie in one scope, and `copies` are one vector again and again."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(nm, DIM)).astype(np.float32)
    vectors[:copies] = vectors[0]
    scope = ["global" if rng.random() < hot else f"user:{rng.integers(users)}" for _ in range(nm)]
    memories = pd.DataFrame({"id": [f"m{i:04d}" for i in rng.permutation(nm)], "scope": scope})
    memories["vector"] = [v.tolist() for v in vectors]
    asked = rng.normal(size=(nq, DIM)).astype(np.float32)
    asked[0] = vectors[0]
    scopes = [None if i % 7 == 0 else ["global", f"user:{rng.integers(users + 2)}"] for i in range(nq)]
    queries = pd.DataFrame({"query_id": list(range(nq)), "vector": [v.tolist() for v in asked], "scopes": scopes})
    types_q = "query_id long, vector array<float>, scopes array<string>"
    types_m = "id string, scope string, vector array<float>"
    q = spark.createDataFrame([tuple(r) for r in queries.itertuples(index=False)], types_q)
    m = spark.createDataFrame([tuple(r) for r in memories.itertuples(index=False)], types_m)
    return queries, memories, q, m


FORMS = {"cells": {}}


@pytest.fixture(params=["cells", "small cells", "regions"])
def form(request, monkeypatch):
    if request.param == "regions":
        monkeypatch.setattr(regions, "FIRST", 25)
        return {"regions": 9}
    if request.param == "small cells":
        monkeypatch.setattr(similarity, "HELD_BYTES", 7 * DIM * similarity.HELD_PER_COMPONENT)
        monkeypatch.setattr(similarity, "LEAST_MEMORIES", 23)
        monkeypatch.setattr(similarity, "SMALL", 5)
    return FORMS["cells"]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_scoped_equals_brute_force(spark, form, metric):
    queries, memories, q, m = make(spark)
    got = rows_of(knn_join(q, m, k=4, min_score=-3.0, metric=metric, query_scopes="scopes", **form))
    assert_same(got, brute_force(queries, memories, 4, -3.0, metric))


def test_unscoped_without_floor(spark, form):
    queries, memories, q, m = make(spark, seed=2)
    got = rows_of(knn_join(q, m, k=3, min_score=None, **form))
    assert_same(got, brute_force(queries.assign(scopes=None), memories, 3, None, "l2"))


def test_copies_and_ties_go_to_smallest_ids(spark, form):
    queries, memories, q, m = make(spark, copies=120, seed=3)
    got = rows_of(knn_join(q, m, k=5, min_score=None, query_scopes="scopes", **form))
    assert_same(got, brute_force(queries, memories, 5, None, "l2"))


def test_only_scoped_queries(spark, form):
    queries, memories, q, m = make(spark, seed=4)
    scoped = q.where("scopes is not null")
    got = rows_of(knn_join(scoped, m, k=4, min_score=None, query_scopes="scopes", **form))
    assert_same(got, brute_force(queries[queries["scopes"].notna()], memories, 4, None, "l2"))


def test_hits_lie_in_allowed_scopes_and_fall_in_score(spark, form):
    _, memories, q, m = make(spark, seed=5)
    hits = knn_join(q, m, k=6, min_score=None, query_scopes="scopes", **form).toPandas()
    scope = dict(zip(memories["id"], memories["scope"]))
    allowed = {r["query_id"]: r["scopes"] for r in q.collect()}
    assert all(allowed[h.query_id] is None or scope[h.id] in allowed[h.query_id] for h in hits.itertuples())
    ordered = hits.sort_values(["query_id", "rank"])
    assert (ordered.groupby("query_id")["score"].diff().dropna() <= 0).all()
    assert (ordered.groupby("query_id")["rank"].agg(list).map(lambda r: r == list(range(1, len(r) + 1)))).all()


def test_rows_without_vector_are_left_out(spark, form):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, vector array<float>")
    m = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "id string, vector array<float>")
    got = rows_of(knn_join(q, m, min_score=None, **form))
    assert got == [(1, 1, "a", 1.0)]


def test_no_queries_or_no_memories(spark, form):
    _, _, q, m = make(spark, nq=5, nm=20)
    assert knn_join(q.where("false"), m, query_scopes="scopes", **form).count() == 0
    assert knn_join(q, m.where("false"), query_scopes="scopes", **form).count() == 0


def test_vectors_of_other_length_are_an_error(spark, form):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    m = spark.createDataFrame([("a", [1.0, 0.0, 2.0])], "id string, vector array<float>")
    with pytest.raises(Exception, match="differ in length"):
        knn_join(q, m, min_score=None, **form).collect()


def test_zero_vector_has_cosine_zero(spark, form):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    m = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, -1.0])], "id string, vector array<float>")
    got = rows_of(knn_join(q, m, min_score=None, metric="cosine", **form))
    assert got == [(1, 1, "a", 0.0), (1, 2, "b", 0.0)]


def test_result_does_not_depend_on_partitions(spark, form):
    _, _, q, m = make(spark, seed=6, copies=50)
    one = rows_of(knn_join(q, m.coalesce(1), k=5, min_score=None, query_scopes="scopes", **form))
    many = rows_of(knn_join(q, m.repartition(13), k=5, min_score=None, query_scopes="scopes", **form))
    assert one == many


def test_hot_scope_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LEAST_MEMORIES", 10)
    monkeypatch.setattr(similarity, "SMALL", 10)
    _, _, q, m = make(spark, nm=300, hot=0.5)
    key = F.concat(F.lit("="), "scope")
    asked = q.withColumn("key", F.explode(F.transform(F.coalesce("scopes", F.array(F.lit("global"))), lambda s: F.concat(F.lit("="), s))))
    parts = similarity._planned(asked, m.withColumn("key", key))
    assert parts.where("key = '=global'").first()["mp"] >= 8


@pytest.mark.parametrize(
    "queries,memories,dimension,cells",
    [(10**7, 10**9, 1024, 16_000), (10**7, 10**9, 64, 16_000), (2000, 2000, 64, 16), (1, 10**9, 1024, 16_000), (10**7, 10, 64, 100)],
)
def test_cell_plan(spark, queries, memories, dimension, cells):
    plan = similarity.cell_plan(*(F.lit(float(x)) for x in (queries, memories, dimension, cells)))
    qp, mp = spark.range(1).select(*plan).first()
    assert (mp <= 1000 or queries * mp <= memories) and qp <= 1000  # how often a query, and a memory, is copied
    assert queries / qp * dimension * similarity.HELD_PER_COMPONENT <= similarity.HELD_BYTES
    assert qp * mp >= min(cells, memories / similarity.LEAST_MEMORIES) and mp <= max(1, memories / similarity.LEAST_MEMORIES + 1)


def test_regions_leave_out_what_cannot_rank(spark, monkeypatch):
    monkeypatch.setattr(regions, "FIRST", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, DIM)) * 10
    vectors = (np.repeat(centres, 100, axis=0) + rng.normal(size=(3000, DIM)) * 0.3).astype(np.float32)
    asked = (centres[rng.integers(30, size=50)] + rng.normal(size=(50, DIM)) * 0.3).astype(np.float32)
    m = spark.createDataFrame([(f"m{i:04d}", v.tolist(), i) for i, v in enumerate(vectors)], "id string, vector array<float>, spread long")
    q = spark.createDataFrame([(i, v.tolist(), float("-inf")) for i, v in enumerate(asked)], "query_id long, vector array<float>, floor double")
    _, known = regions.fit(m, 60, "l2")
    first = [len(r["regions"]) for r in regions.send(q, known, False).collect()]
    exact = rows_of(knn_join(q, m, k=5, min_score=None))
    kth = {g[0]: g[3] for g in exact if g[1] == 5}
    floors = spark.createDataFrame([(i, v.tolist(), kth[i] - 1e-9) for i, v in enumerate(asked)], "query_id long, vector array<float>, floor double")
    second = [sum(known.rows[r] for r in row["regions"]) for row in regions.send(floors, known, True).collect()]
    assert sum(second) < 0.2 * 50 * 3000 and max(first) < 12
    assert rows_of(knn_join(q, m, k=5, min_score=None, regions=60)) == exact


def test_region_bounds_hold():
    rng = np.random.default_rng(4)
    rows, asked = rng.normal(size=(400, DIM)), rng.normal(size=(30, DIM))
    for metric in ("l2", "cosine"):
        base = regions._unit(rows) if metric == "cosine" else rows
        known = regions.Regions(regions.choose_pivots(base, 12), metric)
        placed = known.placed(rows)
        near = placed.argmin(axis=1)
        for r in range(len(known.pivots)):
            own = placed[near == r, r]
            known.rows[r], known.least[r], known.most[r] = len(own), own.min(initial=np.inf), own.max(initial=-np.inf)
        true = regions._distances(regions._unit(asked) if metric == "cosine" else asked, base)
        possible = known.nearest_possible(known.placed(asked))
        for r in np.unique(near):
            assert (possible[:, r][:, None] <= true[:, near == r]).all()


def test_plans_have_no_pairwise_join(spark):
    _, _, q, m = make(spark, nq=5, nm=20)
    for form in FORMS.values():
        plan = plan_of(knn_join(q, m, query_scopes="scopes", **form))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle


def test_counts_do_not_read_vectors(spark, tmp_path):
    _, _, q, m = make(spark, nq=5, nm=20)
    m.write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    plan = plan_of(knn_join(q, stored, query_scopes="scopes"))
    assert "ReadSchema: struct<scope:string>" in plan


def test_top_k_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9)], "query_id int, id string, score double")
    assert [r["id"] for r in top_k(df, 2).orderBy("rank").collect()] == ["c", "a"]


@pytest.mark.parametrize("batch", [1, 3, 50])
def test_running_top_k_in_batches(batch):
    rng = np.random.default_rng(7)
    queries = rng.normal(size=(6, 4)).astype(np.float32)
    rows = rng.integers(-1, 2, size=(90, 4)).astype(np.float32)  # few distinct vectors: many ties
    ids = np.array([f"i{i:03d}" for i in rng.permutation(90)], dtype=object)
    running = RunningTopK(np.arange(6), queries, 4, None, "l2")
    for start in range(0, 90, batch):
        running.add(ids[start : start + batch], rows[start : start + batch])
    gaps = queries[:, None, :].astype(float) - rows[None].astype(float)
    scores = 1.0 - (gaps**2).sum(axis=2)
    for q in range(6):
        want = [i for _, i in sorted(zip(-scores[q], ids))[:4]]
        got = running.result()
        assert sorted(got[got["query_id"] == q]["id"]) == sorted(want)


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e9, 1e25])
def test_running_top_k_for_vectors_of_any_length(scale):
    rng = np.random.default_rng(8)
    queries = (rng.normal(size=(5, 16)) * scale).astype(np.float32)
    rows = (rng.normal(size=(5000, 16)) * scale).astype(np.float32)
    rows[::2] = rows[0] + (rng.normal(size=(2500, 16)) * scale * 1e-6).astype(np.float32)  # many near copies
    for metric in ("l2", "cosine"):
        running = RunningTopK(np.arange(5), queries, 3, None, metric)
        running.add(np.arange(5000), rows)
        q, r = queries.astype(float), rows.astype(float)
        if metric == "l2":
            scores = np.array([[1.0 - ((a - b) ** 2).sum() for b in r] for a in q])
        else:
            scores = (q @ r.T) / np.sqrt((q * q).sum(1)[:, None] * (r * r).sum(1)[None, :])
        got = running.result()
        for i in range(5):
            best = np.sort(scores[i])[-3:]
            assert np.allclose(np.sort(got[got["query_id"] == i]["score"]), best, rtol=1e-12, atol=1e-12)


def test_what_a_cell_holds_is_planned_by_its_queries_and_hits(spark):
    """A task's memory is that of the plan, beside a part that is the same for any number of queries."""
    dimension, k = 64, 10
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(4096, dimension)).astype(np.float32)

    def peak(n):
        queries = rng.normal(size=(n, dimension)).astype(np.float32)
        tracemalloc.start()
        running = RunningTopK(np.arange(n), queries, k, None, "l2")
        running.add(np.arange(4096), rows)
        running.result()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    held = dimension * similarity.HELD_PER_COMPONENT + k * similarity.HELD_PER_HIT
    assert peak(24 * 1024) - peak(4 * 1024) <= 20 * 1024 * held / 2
    plan = similarity.cell_plan(*(F.lit(x) for x in (1e6, 1e6, float(dimension), 100.0)), k)
    assert spark.range(1).select(*plan).first()[0] * similarity.HELD_BYTES >= 1e6 * held
