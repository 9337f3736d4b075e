"""Preference text against plain lists of turns."""

import random

from memoloom.llm import preferences


def plain(rows):
    talks = {}
    key = lambda v: (v is not None, v or 0)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((key(turn), role or "", text or ""))
    talks = {c: [(r, t) for _, r, t in sorted(said)] for c, said in talks.items()}
    last = {c: max((i for i, (r, _) in enumerate(said) if r == "assistant"), default=None) for c, said in talks.items()}
    out = []
    for c, said in talks.items():
        other = list(said)
        if last[c] is not None:
            following = talks.get(c + 1)
            swap = [("assistant", following[last[c + 1]][1])] if following and last[c + 1] is not None else []
            other = said[: last[c]] + swap + said[last[c] + 1 :]
        n = 0
        while n < min(len(said), len(other)) and said[n] == other[n]:
            n += 1
        show = lambda turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)

        def mask(turns, n=n, said=said, show=show):
            at, spans = len(show(said[:n])), []
            for r, t in turns[n:]:
                start = at + len(f"<|im_start|>{r}\n")
                if r == "assistant":
                    spans.append(f"{start}-{start + len(t) + len('<|im_end|>')}")
                at += len(show([(r, t)]))
            return ",".join(spans)

        out.append((c, n, show(said[:n]), show(said[n:]), show(other[n:]), mask(said), mask(other)))
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, pair_id long")
    return sorted(tuple(r) for r in preferences.preference_text(df).collect())


def test_against_plain_lists(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        for turn in range(rng.randrange(1, 8)):
            rows.append((c + c // 20, turn, rng.choice(("user", "assistant", "assistant", "system")), rng.choice(("hi", "yes\nno", "", "größer 日本", "bye"))))
    rows += [(200, 0, None, "x"), (200, None, "user", None), (200, 1, "assistant", None), (201, 0, "assistant", "same"), (202, 0, "assistant", "same"), (202, 0, "assistant", "same")]
    rows += [(None, 0, "user", "lost"), (300, 0, "user", "word " * 50_000), (300, 1, "assistant", "é" * 50_000), (301, 0, "assistant", "short")]
    rows += [(400, i, ("user", "assistant")[i % 2], str(i)) for i in range(2000)]
    rng.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = preferences.preference_text(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shared_prompt(spark):
    side = lambda reply: spark.createDataFrame([(1, [("user", "q"), ("assistant", reply)])], "pair_id long, turns array<struct<role:string,text:string>>")
    row = preferences.formatted(side("good"), side("bad")).first()
    assert row["prompt"] == "<|im_start|>user\nq<|im_end|>\n"
    for name, reply in (("chosen", "good"), ("rejected", "bad")):
        whole = row["prompt"] + row[name]
        assert [whole[s["start"] : s["end"]] for s in row[f"{name}_mask"]] == [reply + "<|im_end|>"]
