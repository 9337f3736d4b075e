"""Positional index against plain scanning of word lists."""

import hashlib
import random
import re

from memoloom.llm import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item_id, item in items:
            test = plain_words(item)
            n = min(window, len(test))
            for i in range(len(test) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == test[i : i + n]:
                        hit.update(range(at, at + n))
                        if item_id is not None:
                            found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def rows(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, phrase string, n long")
    b = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, start string, words long")
    return sorted((tuple(r) for r in contamination.contaminated(d, b, **more).collect()), key=repr)


def test_against_plain_scan(spark):
    rng = random.Random(4)
    words = ["the", "of", "And", "a1", "zwölf", "ÉCLAIR", "x", "yes"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(("", ",", ".", "!\n")) for _ in range(n))
    items = [(i, text(rng.choice((1, 3, 9, 10, 11, 25)))) for i in range(12)] + [(90, None), (91, " .. "), (92, "x x x x x x x x x x x x"), (None, "rare word here")]
    docs = [(i, text(rng.choice((0, 2, 30, 80)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, text(40) + " " + items[5][1] + " " + text(5)), (102, "x " * 40), (103, "x " * 40), (103, "x " * 40), (None, items[4][1]), (104, "a rare word here")]
    docs.append((105, "yes " * 30000 + items[6][1]))
    assert rows(spark, docs, items) == plain(docs, items)


def test_smaller_windows(spark):
    docs = [(1, "one two three four five"), (2, "two three"), (3, "three two")]
    items = [(7, "Two Three four"), (8, "five"), (7, "Two Three four")]
    assert rows(spark, docs, items, window=2) == plain(docs, items, 2)


def test_empty_tables(spark):
    assert rows(spark, [], [(1, "a b")]) == []
    assert rows(spark, [(1, "a b")], []) == plain([(1, "a b")], [])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha so beta then gamma"), (3, "alpha " + "z " * 20 + "beta gamma"), (4, "gamma beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    cut = contamination.cut_documents(docs)
    picked = contamination.rarest_words(cut, contamination.test_windows(items))
    index = contamination.build_index(cut, picked)
    near = {r["doc_id"] for r in contamination.proximity_matches(index, picked, slop=4).collect()}
    assert near == {1, 2}
    assert {r["doc_id"] for r in contamination.proximity_matches(index, picked, slop=0).collect()} == {1}
    assert {r["doc_id"] for r in contamination.intersected(index, picked).collect()} == {1}


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    plan = contamination.contaminated(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
