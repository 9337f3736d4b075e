"""Near copies against all pairs compared in plain Python."""

import random

import corpus_pipeline
from memoloom.llm import near_copies

SF_DIR = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    """id -> smallest id reachable over similarities of 0.8 or more, comparing everything."""
    sets = {i: plain_shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def planted(seed=4):
    """Texts of random words, copies of each at growing distances, chains, one large group and a line that all share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    line = "this very common line stands in each of the texts of this corpus "
    out = []
    for size in (1, 4, 5, 6, 12, 40, 90, 200):
        for _ in range(4):
            text = [word() for _ in range(size)]
            for changes in (0, 1, 1, 2, 3, 5):
                own = list(text)
                for _ in range(changes):
                    own[rng.randrange(size)] = word()
                out.append(" ".join(own))
                text = own if rng.random() < 0.3 else text
    base = [word() for _ in range(150)]
    for k in range(60):
        own = list(base)
        for _ in range(1 + k % 5):
            own[rng.randrange(150)] = word()
        out.append(" ".join(own))
    out += [line + " ".join(word() for _ in range(20)) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out))


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return near_copies.near_copies(docs).collect()


def test_every_near_copy_is_joined(spark):
    rows = planted()
    assert {r["doc_id"]: r["component_id"] for r in got(spark, rows)} == plain_components(rows)


def test_edges(spark):
    rows = [(5, "A b c"), (3, "a  B\tc"), (9, ""), (8, None), (4, "one two three four five"), (4, "one two three four five"), (6, "one two three four"), (None, "a b c"), (None, "only here")]
    out = got(spark, rows)
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in out if r["component_id"] is not None) == [(0, 3), (3, 3), (4, 4), (4, 4), (5, 3), (6, 6), (8, 8), (9, 8)]
    assert len(out) == len(rows)
    assert got(spark, rows[:0]) == []


def test_pipeline_stage_drops_copies_that_differ_in_many_bits(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = plain_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect())
    assert kept == sorted(i for i, c in want.items() if i == c)
    assert not {145, 177} & set(kept)  # near copies more than three bits apart
