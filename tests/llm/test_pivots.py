"""Pivot elimination against scoring everything."""

import math
import random

import numpy as np
from conftest import plan_of

from memoloom.llm import pivots


def plain(rows, k, step):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(float(np.float32(x)) * 1024) for x in v]))
    out = []
    for q in sorted({i for i, _ in usable if i % step == 0}):
        own = min(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in usable if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def got(spark, rows, k, step):
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, near int, cell string")
    return sorted(tuple(r) for r in pivots.nearest_to_every(df, k, step).collect())


def test_against_all_scores(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 64)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 4)
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(500)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # one vector, many rows
    rows += [(2000, None), (2001, [1.0, None, 2.0]), (2002, [math.nan] * 6), (2003, [math.inf] * 6), (None, [1.0] * 6)]
    rows += [(2005, []), (2006, [3.0]), (2007, [1.0] * 9), (50, [0.1] * 6), (60, rows[60][1]), (2008, [1e30] * 2), (2009, [0.0] * 6)]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 2008]
    assert got(spark, rows, 7, 10) == plain(rows, 7, 10)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5])]
    assert got(spark, rows, 10, 100) == plain(rows, 10, 100)
    assert got(spark, [], 10, 100) == []
    assert got(spark, [(3, [1.0])], 10, 100) == []


def test_bounds_spare_work():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (20, 16))
    vectors = np.repeat(centres, 50, axis=0) + rng.integers(-20, 20, (1000, 16))
    table = pivots.choose_pivots(vectors)
    best = pivots.Best(np.array([-1]), vectors[:1], pivots._distances(vectors[:1], table), 10)
    assert best.meet(np.arange(1000), vectors, pivots._distances(vectors, table)) < 300
    scores = vectors @ vectors[0]
    assert best.found[0] == sorted(zip((-scores).tolist(), range(1000), strict=True))[:10]


def test_queries_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    monkeypatch.setattr(pivots, "BLOCK", 16)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 4)
    plans = []
    for name in ("written", "materialized"):
        if kept := getattr(pivots, name, None):
            monkeypatch.setattr(pivots, name, lambda df, to, kept=kept: (plans.append(plan_of(df)), kept(df, to))[1])
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    result = pivots.nearest_to_every(df, 5, 10)
    plans.append(plan_of(result))
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in result.collect()) == plain(rows, 5, 10)


def test_many_parts_and_cells(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 4)
    monkeypatch.setattr(pivots, "cell_plan", lambda *_: (3, 4))
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(rng.choice([3, 4]))]) for i in range(200)]  # many ties
    rows += [(i, [1.0, 2.0, 3.0]) for i in (7, 7, 10, 20)]
    assert got(spark, rows, 6, 10) == plain(rows, 6, 10)


def test_copies_of_queries_stay_below_the_candidates():
    for n in (50_000, 1_000_000, 15_000_000, 75_000_000):
        parts, cells = pivots.cell_plan(n // 100, n, 64, 10, 3000, 6)
        assert cells * (n // 100) <= n and parts * cells >= 12
        assert n // 100 / parts * 64 * 12 <= pivots.HELD_BYTES
    assert pivots.cell_plan(1, 1, 3, 10, 200, 8) == (1, 1)
    assert pivots.cell_plan(10**6, 10, 3, 10, 200, 8)[1] == 1


def test_large_numbers_and_ties():
    rng = np.random.default_rng(2)
    for top in (3, 2**10, 2**20, 2**29, 2**30):
        vectors = rng.integers(-top, top, (400, 5))
        vectors[50:150] = vectors[0]
        ids = rng.permutation(400)
        table = pivots.choose_pivots(vectors)
        gaps = pivots._distances(vectors, table)
        best = pivots.Best(ids[:40], vectors[:40], gaps[:40], 7)
        for start in range(0, 400, 130):
            best.meet(ids[start : start + 130], vectors[start : start + 130], gaps[start : start + 130])
        whole = vectors.astype(object)
        for q in range(40):
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), int(i)) for i, v in zip(ids, whole) if i != ids[q])
            assert best.found[q] == [(int(s), i) for s, i in scores[:7]]
