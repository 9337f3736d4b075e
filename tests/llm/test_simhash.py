"""Fingerprints against a plain reading of their definition, links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memoloom.llm import simhash
from memoloom.llm.components import components
from memoloom.llm.gray_index import GrayIndex, gray_rank, gray_value


def plain_fingerprint(text):
    words = []
    for word in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if word:
            words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """id -> smallest id reachable over differences of at most three bits, comparing everything."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", "A b C", "a b c d", "Ünter den\x0bLinden x ÀB c", "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_gray_rank_is_a_bijection_that_keeps_leading_blocks():
    values = np.arange(1 << 12, dtype=np.uint64) << np.uint64(50)
    assert (gray_value(gray_rank(values)) == values).all()
    steps = gray_value(np.arange(1000, dtype=np.uint64))
    assert (np.bitwise_count(steps[1:] ^ steps[:-1]) == 1).all()
    assert len(np.unique(gray_rank(np.uint64(77 << 48) | np.arange(999, dtype=np.uint64)) >> np.uint64(48))) == 1


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 6)]
    out = set()
    while len(out) < n:
        value = rng.choice(centres)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            value ^= 1 << rng.randrange(64)
        out.add(value)
    return sorted(out)


def test_index_finds_every_link():
    values = np.array(clustered(700, 3), np.uint64)
    values = values[np.argsort(gray_rank(values))]
    index = GrayIndex(values, np.zeros(len(values), np.int64))
    found = {(int(a), int(b)) for i, j in index.links(index, 3) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= 3}
    assert found == want


@pytest.mark.parametrize("chunk,batch", [(2048, 1 << 15), (8, 64)])
def test_links_across_chunks(spark, monkeypatch, chunk, batch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "BATCH", batch)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    dense = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) for _ in range(400)}
    prints = dict(enumerate(sorted(dense | set(clustered(500, 9)) | {0, 1})))
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()]
    got = {r["node"]: r["component"] for r in simhash.link_fingerprints(spark.createDataFrame(rows, "fp long, node long")).collect()}
    want = plain_components(prints)
    assert {i: got.get(i, i) for i in prints} == want


def test_components_on_a_long_path(spark):
    edges = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    edges = edges.union(spark.createDataFrame([(900, 901), (901, 900), (7, 7)], "a long, b long"))
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def test_rows_of_documents(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    texts = [(5, "a b c"), (3, "A b C"), (9, ""), (8, None), (4, "quite another text here"), (7, long), (2, long + " more"), (4, "quite another text here"), (None, "a b c")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], "doc_id long, text string, fp string, node string, component string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    prints = {i: plain_fingerprint(t) for i, t in texts if i is not None}
    want = plain_components(prints)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
        else:
            assert r["component_id"] == 3
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
