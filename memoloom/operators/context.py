"""Ordered text assembly: session transcripts and the context handed to the answering model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoloom.functions.scopes import column_or
from memoloom.functions.columns import col
from memoloom.schemas import DEFAULT_CATEGORY, GLOBAL_SCOPE

# Line formats and their fillers.
DATE_OPEN, DATE_CLOSE = "[Session Date: ", "]"
UNKNOWN_SPEAKER = "Unknown"

# How many turns are gathered at a time while a transcript is put together.
TURNS_PER_PART = 1024


def turn_line(speaker: Column | str, text: Column | str) -> Column:
    return F.concat(F.coalesce(col(speaker), F.lit(UNKNOWN_SPEAKER)), F.lit(": "), F.coalesce(col(text), F.lit("")))


def with_date(body: Column, date: Column | str | None) -> Column:
    """The transcript under its date line; no line for a null or empty date."""
    if date is None:
        return body
    date = F.coalesce(col(date).cast("string"), F.lit(""))
    header = F.when(date != "", F.concat(F.lit(DATE_OPEN), date, F.lit(DATE_CLOSE)))
    return F.concat_ws("\n", header, F.nullif(body, F.lit("")))


def transcript_of(turns: Column | str, date: Column | str | None = None) -> Column:
    """Transcript of an array of turns (speaker, text) in the order given."""
    lines = F.transform(col(turns), lambda t: turn_line(t["speaker"], t["text"]))
    return with_date(F.array_join(lines, "\n"), date)


def transcript_parts(
    turns: DataFrame,
    by: list[str],
    order: str = "turn",
    speaker: str = "speaker",
    text: str = "text",
    date: str | None = None,
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """Transcripts from rows of turns: by, part, transcript, turns.

    `order` numbers the turns of a session from its start, without repeats. Sessions whose numbers stay below
    `turns_per_part` are one part, number 0. Longer ones come in consecutive parts, the first under the date line,
    so no task gathers more than a part however long a session is.
    """
    lines = turns.select(
        *by,
        F.floor(F.col(order) / turns_per_part).alias("part"),
        F.col(order).alias("_order"),
        turn_line(speaker, text).alias("_line"),
        (F.col(date) if date else F.lit(None).cast("string")).alias("_date"),
    )
    parts = lines.groupBy(*by, "part").agg(
        F.expr("listagg(_line, '\\n') WITHIN GROUP (ORDER BY _order)").alias("_text"),
        F.max("_date").alias("_date"),
        F.count(F.lit(1)).alias("turns"),
    )
    header = F.when(F.col("part") == 0, F.col("_date"))
    return parts.select(*by, "part", with_date(F.col("_text"), header).alias("transcript"), "turns")


def transcripts(turns: DataFrame, by: list[str], **options) -> DataFrame:
    """by, transcript, turns: one transcript per session, however long. A transcript is one value of one row; on the way
    there a task gathers the lines of a part, then the parts of a session."""
    parts = transcript_parts(turns, by, **options)
    return parts.groupBy(*by).agg(
        F.expr("listagg(transcript, '\\n') WITHIN GROUP (ORDER BY part)").alias("transcript"),
        F.sum("turns").alias("turns"),
    )


def three_decimals(score: Column) -> Column:
    """Rounded half to even on the binary value, as C-style formatting does."""
    return F.replace(F.format_number(score, 3), F.lit(","), F.lit(""))


def hit_line(df: DataFrame) -> Column:
    return F.concat(
        F.lit("["),
        F.col("rank").cast("string"),
        F.lit("] (id="),
        F.coalesce(F.col("id").cast("string"), F.lit("")),
        F.lit(", category="),
        F.coalesce(column_or(df, "category"), F.lit(DEFAULT_CATEGORY)),
        F.lit(", scope="),
        F.coalesce(column_or(df, "scope"), F.lit(GLOBAL_SCOPE)),
        F.lit(", score="),
        three_decimals(F.coalesce(column_or(df, "score", as_type="double"), F.lit(0.0))),
        F.lit(") "),
        F.coalesce(column_or(df, "text"), F.lit("")),
    )


def contexts(hits: DataFrame) -> DataFrame:
    """query_id, context, context_ids from ranked hits: one numbered line each, best first. At most k rows per query."""
    lines = hits.select("query_id", "rank", F.col("id").cast("string").alias("id"), hit_line(hits).alias("line"))
    listed = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line", "id"))).alias("h"))
    return listed.select(
        "query_id", F.array_join(F.col("h.line"), "\n").alias("context"), F.col("h.id").alias("context_ids")
    )


def attach_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Every question with its context; empty context and ids without hits."""
    return questions.join(contexts(hits), "query_id", "left").withColumns(
        {
            "context": F.coalesce("context", F.lit("")),
            "context_ids": F.coalesce("context_ids", F.array().cast("array<string>")),
        }
    )
