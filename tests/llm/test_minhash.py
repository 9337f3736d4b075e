"""MinHash near-duplicates against all pairs compared in plain Python."""

import random

import numpy as np
import pytest

from memoloom import workspace
from memoloom.llm import minhash


def plain_shingles(text, words):
    found = (text or "").encode().lower().split()
    return frozenset(b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def plain(rows, words=4):
    """Sorted (doc_id, n_shingles, component_id, kept), comparing everything; ids are distinct."""
    sets = {i: plain_shingles(t, words) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in ids]


def planted(seed=4):
    """Texts of random words, copies of each at growing distances, chains, a large group and a line that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    line = "this very common line stands in each of the texts of this corpus "
    out = []
    for size in (1, 3, 4, 5, 12, 40, 90, 200):
        for _ in range(4):
            text = [word() for _ in range(size)]
            for changes in (0, 1, 1, 2, 3, 5):
                own = list(text)
                for _ in range(changes):
                    own[rng.randrange(size)] = word()
                out.append(" ".join(own))
                text = own if rng.random() < 0.3 else text
    base = [word() for _ in range(150)]
    for k in range(120):
        own = list(base)
        for _ in range(1 + k % 5):
            own[rng.randrange(150)] = word()
        out.append(" ".join(own))
    out += [line * 3 + " ".join(word() for _ in range(20)) for _ in range(60)]
    out += ["", "  \t ", "A b", "a  B"]
    rng.shuffle(out)
    return list(enumerate(out))


def got(spark, rows):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n long, key string")
    return sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)


@pytest.mark.parametrize("cell,hub", [(minhash.CELL, minhash.HUB), (7, 5)])
def test_every_link_is_found(spark, monkeypatch, cell, hub):
    monkeypatch.setattr(minhash, "CELL", cell)
    monkeypatch.setattr(minhash, "HUB", hub)
    rows = planted()
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_edges(spark):
    rows = [(5, "A b c"), (3, "a  B\tc"), (9, ""), (8, None), (4, "one two three four"), (4, "one two three four"), (6, "one two three"), (None, "a b c"), (None, "only here"), (None, None)]
    want = [(3, 1, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 3, False), (6, 1, 6, True), (8, 0, 8, True), (9, 0, 9, True)]
    want += [(None, 0, None, True), (None, 1, 3, False), (None, 1, None, True)]
    assert got(spark, rows) == sorted(want, key=str)
    assert got(spark, []) == []


def test_a_very_long_text(spark):
    rng = random.Random(3)
    words = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    other = list(words)
    for k in range(0, 60_000, 60):
        other[k] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:30_000]))]
    assert got(spark, rows) == sorted(plain(rows), key=str)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(5)
    off = []
    for similarity in (0.65, 0.8, 0.9, 0.97):
        for _ in range(40):
            size = int(rng.integers(50, 1500))
            common = round(2 * size * similarity / (1 + similarity))
            pool = rng.integers(0, 2**63, 2 * size, np.uint64)
            a, b = pool[:size], np.r_[pool[:common], pool[size : 2 * size - common]]
            sketches = minhash.odd_sketches(np.array([minhash.samples(a), minhash.samples(b)]))
            differing = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
            off.append(minhash.estimate(differing) - common / (2 * size - common))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.03
    assert minhash.estimate(minhash.most_differing(minhash.LEAST)) == pytest.approx(minhash.LEAST, abs=0.002)


def test_bands_meet_at_the_similarity():
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(300):
        size = int(rng.integers(9, 300)) // 9 * 9
        pool = rng.integers(0, 2**63, 2 * size, np.uint64)
        common = size * 8 // 9
        a, b = pool[:size], np.r_[pool[:common], pool[size : 2 * size - common]]  # similarity 0.8
        found = minhash.bands(np.array([minhash.samples(a), minhash.samples(b)]))
        met += bool((found[0] == found[1]).any())
    assert met == 300


def test_unlike_texts_of_one_line_give_no_pairs(spark):
    rng = random.Random(1)
    rows = [(i, "a line that all of these texts share " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = minhash._prints(docs, 4).select("doc_id", "bands")
    shared = nodes.selectExpr("doc_id", "explode(bands) as b").groupBy("b").count().where("count > 1")
    assert shared.count() < 100


def test_sets_and_buckets_go_once_links_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}")
    rows = [(i, f"these are words that {i // 2} and its copy share between them") for i in range(8)]
    assert got(spark, rows) == plain(rows)
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("*/minhash-*")}
    assert {"minhash-prints", "minhash-nodes", "minhash-linked"} <= left
    assert not left & {"minhash-sets", "minhash-members", "minhash-buckets"}
