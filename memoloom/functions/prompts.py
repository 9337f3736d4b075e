"""Request texts. Templates are parameters; only their placeholders are filled here."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from memoloom.functions.columns import col

# Instructions for the three model uses, worded for this library. Callers may pass their own.
EXTRACTION_INSTRUCTIONS = (
    "Read the conversation and list what is worth remembering about the people in it. State every memory as one "
    "complete sentence that makes sense on its own, with names, dates and numbers where they are known. Reply with a "
    "JSON array of objects holding text, category, importance between 0 and 1, and metadata."
)
ANSWER_INSTRUCTIONS = (
    "Answer the question from the memories listed with it. Keep the answer short, prefer exact names, dates and "
    "numbers, and say so when the memories do not hold the answer."
)
JUDGE_INSTRUCTIONS = "You compare answers with reference answers and decide whether they agree."
JUDGE_TEMPLATE = (
    "Decide whether the given answer agrees with the reference answer. Accept longer answers and other date formats "
    "as long as they mean the same thing.\n\n"
    "Question: {question}\nReference answer: {ground_truth}\nGiven answer: {answer}\n\n"
    'Reply with one JSON object: {{"label": "CORRECT" or "WRONG", "reasoning": "one sentence"}}'
)

# Formats of the plain requests and of the ingest status.
ANSWER_FORMAT = "Question: {question}\n\nRelated Memories:\n{context}"
INGEST_FORMAT = "[remember what's said, keep existing memory]\n\n{text}"
STATUS_FORMAT = "Ingested via chat. Response: {response}"

_TOKEN = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def render(template: str, **values: Column | str) -> Column:
    """`template` with `{name}` replaced by columns, null as empty text; `{{` and `}}` stand for braces."""
    parts: list[Column] = []
    literal, end = "", 0
    for token in _TOKEN.finditer(template):
        literal += template[end : token.start()]
        end = token.end()
        if token.group(1) is None:
            literal += token.group()[0]
            continue
        parts += [F.lit(literal), F.coalesce(col(values[token.group(1)]).cast("string"), F.lit(""))]
        literal = ""
    return F.concat(*parts, F.lit(literal + template[end:]))


def answer_request(question: Column | str, context: Column | str) -> Column:
    return render(ANSWER_FORMAT, question=question, context=context)


def judge_request(question, ground_truth, answer, template: str = JUDGE_TEMPLATE) -> Column:
    return render(template, question=question, ground_truth=ground_truth, answer=answer)


def ingest_request(text: Column | str) -> Column:
    return render(INGEST_FORMAT, text=text)


def ingest_status(response: Column | str) -> Column:
    return render(STATUS_FORMAT, response=response)
