"""Alignment of two tokenizers against whole-text encodings compared token by token in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from memoloom.llm import alignment

SF_DIR = "/root/testdata/sf0.001"


def tokens(texts):
    """(A tokens, B tokens) as (id, start, end) of every text, from whole-text encodings."""
    a_model, b_model = Tokenizer.from_file(alignment.BYTE_LEVEL), SentencePieceProcessor(model_file=alignment.PIECES)
    a_model.encode_special_tokens = True
    letters = alignment._byte_letters()
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        sides = []
        whole = (" " + text).encode()
        found = a_model.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
        b = []
        for i in b_model.encode(text):
            name = b_model.id_to_piece(i)
            b.append((i, bytes([int(name[3:5], 16)]) if b_model.is_byte(i) else name.replace("▁", " ").encode()))
        for side in (a, b):
            at, spans = 0, []
            for i, data in side:
                spans.append((i, at, at + len(data)))
                at += len(data)
            sides.append(spans if b"".join(d for _, d in side) == whole else None)
        out.append(([], []) if None in sides else tuple(sides))
    return out


def plain(rows):
    found = tokens([t for _, t in rows])
    linked, shown = [], []
    for a, b in found:
        links, start = [], 0
        for i, s, e in a:
            while start < len(b) and b[start][2] <= s:
                start += 1
            k = start
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        linked.append(links)
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, x, y = [], 0, 0
        for end in common:
            own = ([], [])
            while x < len(a) and a[x][2] <= end:
                own[0].append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= end:
                own[1].append(str(b[y][0]))
                y += 1
            groups.append(",".join(own[0]) + "|" + ",".join(own[1]))
        shown.append(groups)
    count = Counter(p for links in linked for p in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), (a, b), links, groups in zip(rows, found, linked, shown, strict=True):
        best = sum(count[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), digest))
    return out


def got(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row long, code string")
    return [tuple(r) for r in alignment.align(docs).collect()]


def odd_texts(seed=2):
    rng = random.Random(seed)
    pieces = ["word", "Über", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", " ", "　", "▁", "don't", "I'll", "12345", "<s>", "</s>", "<0x41>", "<|endoftext|>", "東京", "é", "é", "😀", "...", ";\r", "\x00", "\x1c", "​", "ab", "</", "{\n", "᠎"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(400)]


def test_whole_tables_and_odd_texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = docs + [(10_000 + k, t) for k, t in enumerate(odd_texts())] + [(7, ""), (7, None), (None, "an id is missing"), (7, "again")]
    assert sorted(got(spark, rows), key=str) == sorted(plain(rows), key=str)


def test_stretches_give_the_ids_of_whole_texts():
    own = alignment.Pair(alignment.BYTE_LEVEL, alignment.PIECES)
    assert own.by_stretch
    texts = odd_texts(5) + [" lead", "\nlead", "trail ", "trail\n \n"]
    by_stretch = own.encode(texts)
    own.by_stretch = False
    assert own.encode(texts) == by_stretch


@pytest.mark.parametrize("range_,fan", [(64, 2), (40, 3), (7, 2)])
def test_fragments_compose(spark, monkeypatch, range_, fan):
    monkeypatch.setattr(alignment, "RANGE", range_)
    monkeypatch.setattr(alignment, "FAN", fan)
    monkeypatch.setattr(alignment, "SLICE", 50)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(12).collect()]
    rows = [(i, t[:1500]) for i, t in docs] + [(500, "x" * 300 + "y"), (501, "東京都" * 60), (502, " " * 200), (503, "a" * 20)]
    assert sorted(got(spark, rows)) == sorted(plain(rows))


def test_composition_is_associative():
    rng = random.Random(4)
    for _ in range(200):
        parts = []
        for seq in range(3):
            cut = rng.random() < 0.6
            ids = lambda: ([rng.randrange(9)], [rng.randrange(9)])
            parts.append(alignment.Fragment(cut, seq if cut else None, ids(), ids() if cut else ([], [])))
        (ab, g1), (bc, h1) = parts[0].then(parts[1]), parts[1].then(parts[2])
        (left, g2), (right, h2) = ab.then(parts[2]), parts[0].then(bc)
        assert vars(left) == vars(right)
        assert sorted(str(g) for g in (g1, g2) if g) == sorted(str(g) for g in (h1, h2) if g)


def test_empty_table(spark):
    assert got(spark, []) == []


class Counted:
    """A tokenizer that counts the texts it is asked for."""

    def __init__(self, own):
        self.own, self.texts = own, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.own.encode_batch_fast(texts, **options)


def test_new_words_go_to_the_tokenizer_many_at_a_time():
    own, plainly = (alignment.Pair(alignment.BYTE_LEVEL, alignment.PIECES) for _ in range(2))
    own.a, plainly.by_stretch = Counted(own.a), False
    rng = random.Random(6)
    words = ["".join(rng.choice("aeinorstéß") for _ in range(9)) for _ in range(1000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 1000, 100)] + ["a lost▁one", words[3]]
    assert own.encode(texts) == plainly.encode(texts)
    assert own.a.texts <= 1000 / alignment.TOGETHER + 2 * alignment.TOGETHER
    assert own.encode(texts[-2:]) == plainly.encode(texts[-2:]) and own.encode(texts[-2:])[0] == (b"", b"")


def test_remembered_generations_give_the_same_ids():
    own, plainly = alignment.Pair(alignment.BYTE_LEVEL, alignment.PIECES, remembered=5), alignment.Pair(alignment.BYTE_LEVEL, alignment.PIECES)
    plainly.by_stretch = False
    texts = odd_texts(8)[:60]
    for text in texts + texts[::-1]:
        assert own.encode([text]) == plainly.encode([text])
