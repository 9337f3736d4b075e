"""Model replies: verdicts and nested responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memoloom.functions import jsons
from memoloom.functions.columns import col, let
from memoloom.functions.text import strip, unfence

# Labels and the reasoning given for unusable replies.
CORRECT = "CORRECT"
WRONG = "WRONG"
ERROR = "ERROR"
NOT_AN_OBJECT = "Invalid JSON: "
UNDECODABLE = "JSON Decode Error: "

_RESPONSE = "output array<struct<type:string,text:string,content:array<struct<type:string,text:string>>>>"


def verdict(label: Column, reasoning: Column, score: Column) -> Column:
    return F.struct(
        label.alias("label"), reasoning.alias("reasoning"), score.cast("double").alias("score")
    )


def parse_verdict(reply: Column | str) -> Column:
    """struct<label, reasoning, score> of a grader's reply.

    CORRECT counts 1 and WRONG counts 0, compared in upper case; another label keeps its own numeric score. The
    label itself stays as written.
    """
    reply = col(reply)

    def judge(v: Column) -> Column:
        label = jsons.field(v, "label")
        known = F.upper(strip(label))
        kind = F.coalesce(jsons.kind(jsons.field(v, "score", "variant")), F.lit(""))
        own = F.when(~kind.isin("STRING", "BOOLEAN"), jsons.field(v, "score", "double"))
        score = F.when(known == CORRECT, F.lit(1.0)).when(known == WRONG, F.lit(0.0)).otherwise(own)
        undecodable = verdict(F.lit(ERROR), F.concat(F.lit(UNDECODABLE), reply), F.lit(0.0))
        no_object = verdict(F.lit(WRONG), F.concat(F.lit(NOT_AN_OBJECT), reply), F.lit(0.0))
        return (
            F.when(v.isNull(), undecodable)
            .when(~jsons.is_object(v), no_object)
            .otherwise(verdict(label, jsons.field(v, "reasoning"), score))
        )

    return let(jsons.parse(unfence(reply)), judge)


def response_text(response: Column | str) -> Column:
    """Answer text inside a nested response.

    The first `output_text` part of a message wins, then the first text found in output order, then the raw JSON.
    """
    raw = col(response)

    def find(output: Column) -> Column:
        messages = F.filter(output, lambda item: item["type"] == "message")
        parts = F.flatten(F.transform(messages, lambda item: F.coalesce(item["content"], F.array())))
        answer = F.try_element_at(F.filter(parts, lambda part: part["type"] == "output_text"), F.lit(1))
        texts = F.flatten(F.transform(output, _texts))
        return F.coalesce(
            F.when(answer.isNotNull(), F.coalesce(answer["text"], F.lit(""))), F.try_element_at(texts, F.lit(1)), raw
        )

    return let(F.from_json(raw, _RESPONSE)["output"], find)


def _texts(item: Column) -> Column:
    """An item's own text, or else the texts of its parts."""
    parts = F.coalesce(item["content"]["text"], F.array().cast("array<string>"))
    return F.when(item["text"].isNotNull(), F.array(item["text"])).otherwise(F.filter(parts, lambda t: t.isNotNull()))
