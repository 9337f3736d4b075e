"""Hard negatives against scoring everything in plain Python."""

import math
import random

import numpy as np
import pytest

from memoloom.llm import multi_index


def plain(rows, step=50, positives=5, negatives=3):
    usable = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(float(np.float32(x)) * 256) for x in v], label))
    out = []
    for at, (i, v, label) in enumerate(usable):
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, own) for k, (j, w, own) in enumerate(usable) if k != at)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(t, n) for t, n, own in scored if own != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside)]
    return sorted(out)


def got(spark, rows, **given):
    df = spark.createDataFrame([(i, v, label, 3, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, cell int, row string")
    return sorted(tuple(r) for r in multi_index.hard_negatives(df, **given).collect())


def exact(v):
    return [float(np.float32(x)) for x in v]


def clustered(n=600, dims=8, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, exact(c + rng.gauss(0, 0.4) for c in rng.choice(centres)), rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("first,part,askers", [(40, 16, 3), (multi_index.FIRST, multi_index.PART, multi_index.ASKERS)])
def test_against_all_scores(spark, monkeypatch, first, part, askers):
    monkeypatch.setattr(multi_index, "FIRST", first)
    monkeypatch.setattr(multi_index, "PART", part)
    monkeypatch.setattr(multi_index, "ASKERS", askers)
    rows = clustered()
    rows += [(1000 + i, [0.5] * 8, 1) for i in range(120)]  # one vector, many rows and ties
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [math.nan] * 8, 1), (2150, [math.inf] * 8, 1), (None, [1.0] * 8, 1), (2200, [1.0] * 8, None)]
    rows += [(2250, [], 0), (2300, [3.0], 0), (2350, [1.0] * 11, 2), (50, exact([0.1] * 8), 3), (50, exact([0.1] * 8), 3), (2400, [1.0] * 8, 99), (2450, [-1.0] * 8, 98), (2451, [1.0] * 8, 98)]
    assert got(spark, rows, step=10) == plain(rows, step=10)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.3], 2)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    assert got(spark, [(3, [1.0], 1)]) == []
    assert got(spark, [(0, [1.0], 1)]) == []


def test_walk_falls_and_bounds_hold(spark):
    rows = clustered(800, 16)
    df = spark.createDataFrame([(i, [int(x * 256) for x in v], label) for i, v, label in rows], "id long, vector array<long>, label long")
    index, cells = multi_index.build(df)
    by_cell = {}
    for r in index.collect():
        by_cell.setdefault(r["cell"], []).append(r["vector"])
    query = np.array([int(x * 256) for x in rows[5][1]])
    seen = list(cells.walk(query))
    assert len(seen) == len({c for c, _, _ in seen}) == len(cells.counts)
    assert all(a[1] >= b[1] for a, b in zip(seen, seen[1:]))
    for cell, upper, lower in seen:
        assert all(lower <= np.dot(query, v) <= upper for v in by_cell.get(cell, []))


def test_certified_windows_spare_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (12, 16))
    vectors = np.repeat(centres, 100, axis=0) + rng.integers(-20, 20, (1200, 16))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)], "id long, vector array<long>, label long")
    index, cells = multi_index.build(df)
    floor = sorted((int(vectors[0] @ v) for v in vectors[3::3]), reverse=True)[4]
    asker = spark.createDataFrame([(0, 0, 0, vectors[0].tolist(), [floor], [multi_index.HIGH])], multi_index._ASKER)
    visited = [r["cell"] for r in multi_index.routes(asker, cells, True, False).collect()]
    assert sum(cells.counts[c] for c in visited) < 400
