"""Packing: nothing lost, nothing overlapping, close to the fewest sequences possible."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from memoloom.llm import packing
from memoloom.llm.tokens import VOCABULARY


def best_price(lengths, prices, capacity):
    best = [0.0] * (capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = max([best[room - 1], *(best[room - x] + p for x, p in zip(lengths, prices, strict=True) if x <= room)])
    return best[capacity]


def test_knapsack():
    rng = random.Random(1)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 60), 6))
        prices = [rng.random() for _ in lengths]
        found = packing.best_configurations(np.array(lengths), np.array(prices), 60, 6)
        assert all(sum(lengths[k] * a for k, a in chosen.items()) <= 60 for chosen in found)
        worth = max(sum(prices[k] * a for k, a in chosen.items()) for chosen in found)
        assert worth == pytest.approx(best_price(lengths, prices, 60))


@pytest.mark.parametrize("seed", range(6))
def test_configurations_hold_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = Counter(min(2048, int(rng.paretovariate(0.8) * 40)) for _ in range(rng.choice((3, 500, 20_000))))
    used, sequences = Counter(), 0
    for chosen, times in packing.configurations(dict(histogram)):
        assert sum(x * a for x, a in chosen.items()) <= 2048
        sequences += times
        for x, a in chosen.items():
            used[x] += a * times
    assert used == histogram
    bound = -(-sum(x * n for x, n in histogram.items()) // 2048)
    assert bound <= sequences <= bound * 1.02 + 2


@pytest.mark.parametrize(
    "capacity, histogram, most",
    [
        (100, {54: 36, 99: 29, 14: 31, 88: 8, 1: 13, 44: 36, 16: 29, 45: 3, 58: 26, 61: 30, 18: 37, 13: 33, 36: 414}, 310),
        (100, {36: 10, 74: 10, 15: 26, 95: 1, 68: 1, 88: 3, 26: 20, 38: 3, 52: 7, 75: 8, 59: 35, 27: 1, 34: 455}, 278),
        (60, {6: 27, 18: 7, 54: 3, 25: 35, 36: 22, 22: 4, 21: 213}, 140),
    ],
)
def test_never_worse_than_best_fit(capacity, histogram, most):
    """A length just above a third dominates; the numbers are those of best-fit alone."""
    assert sum(n for _, n in packing.configurations(histogram, capacity)) <= most


def test_one_frequent_length():
    assert sum(n for _, n in packing.configurations({700: 9000})) == 4500
    assert packing.configurations({}) == []


def test_documents(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(("alpha", "be", "gamma!", "d1")) for _ in range(rng.choice((0, 3, 200, 900, 2500))))) for i in range(120)]
    texts += [(200, None), (201, ""), (None, "no id"), (7, texts[7][1]), (202, "word " * 9000), (203, "w")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in texts], "doc_id long, text string, part int, length string")
    rows = packing.pack(docs, with_ids=True).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[(i, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    bound = max(sum(r["length"] for r in rows) / 2048, sum(r["length"] > 1024 for r in rows))
    assert len(sequences) <= bound * 1.03 + 2
    assert packing.pack(docs.limit(0)).collect() == []
