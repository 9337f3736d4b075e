"""Preference pairs as training text: the longest common prefix of turns once as prompt, both continuations masked.

DataFrame functions only. A conversation is one row with an array of its turns, which is what its text becomes anyway;
nothing larger is gathered. Loss is asked for where the assistant speaks: a mask lists [start, end) in characters of
prompt + continuation, from the first character of a reply to the end of its closing mark. Places are running sums over
the turns of a pair, so long conversations take linear time.

Defined results: null texts and roles are empty; turns go by (turn, role, text), nulls first, and repeated rows are
repeated turns; rows with a null conversation id belong to none and take no part. Equal conversations have everything in the
prompt and empty continuations. A pair that lacks a side gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the format.
OPEN, AFTER_ROLE, CLOSE, AFTER_CLOSE = "<|im_start|>", "\n", "<|im_end|>", "\n"
SPEAKER = "assistant"


def gathered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, turns): every conversation as an array of (role, text)."""
    said = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("pair_id"), said.alias("said"))
    ordered = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    return ordered.select("pair_id", F.transform("said", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns that two arrays share from the start."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(chosen)).cast("long")


def rendered(turns: Column) -> Column:
    parts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE + AFTER_CLOSE)))
    return F.array_join(parts, "")


def _mask(rows: DataFrame, turns: str, name: str) -> DataFrame:
    """(pair_id, name): where the assistant speaks in prompt + continuation, as an array of (start, end)."""
    exploded = rows.select("pair_id", "prompt_size", F.posexplode(turns).alias("pos", "t"))
    sized = exploded.select(
        "pair_id", "pos", (F.col("t.role") == SPEAKER).alias("speaks"), F.char_length("t.role").alias("role_size"),
        F.char_length("t.text").alias("text_size"), "prompt_size",
    )
    head, tail = len(OPEN) + len(AFTER_ROLE), len(CLOSE)
    whole = F.col("role_size") + F.col("text_size") + head + tail + len(AFTER_CLOSE)
    before = F.sum(whole).over(Window.partitionBy("pair_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("prompt_size") + F.coalesce(before, F.lit(0)) + F.col("role_size") + head
    spans = sized.select("pair_id", "speaks", start.alias("start"), (start + F.col("text_size") + tail).alias("end"))
    spans = spans.where("speaks").select("pair_id", F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("span"))
    return spans.groupBy("pair_id").agg(F.sort_array(F.collect_list("span")).alias(name))


def formatted(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask of the pairs (pair_id, turns) of both sides."""
    pairs = chosen.select("pair_id", F.col("turns").alias("c")).join(rejected.select("pair_id", F.col("turns").alias("r")), "pair_id")
    pairs = pairs.withColumn("n_common", common_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("n_common").cast("int") + 1, F.greatest(F.size(side), F.lit(1)))
    pairs = pairs.select(
        "pair_id", "n_common", rendered(F.slice("c", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"), rest("c").alias("c"), rest("r").alias("r")
    ).withColumn("prompt_size", F.char_length("prompt"))
    out = pairs
    for turns, name in (("c", "chosen_mask"), ("r", "rejected_mask")):
        out = out.join(_mask(pairs, turns, name), "pair_id", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    masks = [F.coalesce(name, none).alias(name) for name in ("chosen_mask", "rejected_mask")]
    return out.select("pair_id", "n_common", "prompt", rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), *masks)


def with_next_reply(talks: DataFrame) -> DataFrame:
    """Rejected sides for conversations (pair_id, turns) with numbered ids: the last reply of the assistant is exchanged for
    that of the conversation with the next number, or left out if there is none."""
    places = F.transform("turns", lambda t, i: F.when(t["role"] == SPEAKER, i + 1).otherwise(0))
    last = talks.select("pair_id", "turns", F.array_max(places).alias("at"))
    replies = last.where("at > 0").select((F.col("pair_id") - 1).alias("pair_id"), F.element_at("turns", F.col("at").cast("int"))["text"].alias("other"))
    joined = last.join(replies, "pair_id", "left")
    at = F.col("at").cast("int")
    exchanged = F.when(F.col("other").isNull(), F.array().cast("array<struct<role:string,text:string>>")).otherwise(
        F.array(F.struct(F.lit(SPEAKER).alias("role"), F.col("other").alias("text")))
    )
    changed = F.concat(F.slice("turns", F.lit(1), at - 1), exchanged, F.slice("turns", at + 1, F.size("turns")))
    return joined.select("pair_id", F.when(at > 0, changed).otherwise(F.col("turns")).alias("turns"))


def preference_text(turns: DataFrame) -> DataFrame:
    """Pairs of each conversation and its variant with the next conversation's reply; masks as text start-end,..."""
    talks = gathered(turns)
    out = formatted(talks, with_next_reply(talks))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({c: shown(F.col(c)) for c in ("chosen_mask", "rejected_mask")})
