"""Evaluation aggregates over judged answers (column `judge_result` with label, reasoning, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoloom.functions.scopes import column_or
from memoloom.schemas import CORRECT_THRESHOLD

# Marks searched in answers and reasonings, and the fillers of the failure report.
SERVER_ERROR = "500 Internal Server Error"
MISSING_TRUTH = ("No gold", "No valid gold")
MISSING_TRUTH_ANY_CASE = "empty"
UNKNOWN_USER = "unknown"
NO_REASONING = "No reasoning"


def join_back(items: DataFrame, results: DataFrame, on: str = "item_id") -> DataFrame:
    """Items with the results computed for them, by key; items without a result keep null."""
    return items.join(results, on, "left")


def accuracy(judged: DataFrame) -> DataFrame:
    """Mean of the scores there are, 0 when there is none, in one row."""
    score = F.col("judge_result.score")
    return judged.agg(
        F.coalesce(F.avg(score), F.lit(0.0)).alias("accuracy"),
        F.count(score).alias("scored"),
        F.count_if(score < 1.0).alias("failed"),
    )


def failures(judged: DataFrame) -> DataFrame:
    """The answers scored below 1, with their questions."""
    kept = [c for c in ("item_id", "query_id") if c in judged.columns]
    return judged.where(F.col("judge_result.score") < 1.0).select(
        *kept,
        F.coalesce(column_or(judged, "user_id"), F.lit(UNKNOWN_USER)).alias("user_id"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("judge_result.reasoning", F.lit(NO_REASONING)).alias("reasoning"),
        F.col("judge_result.score").alias("score"),
    )


def _percent(part: Column, whole: Column) -> Column:
    return part * 100.0 / F.nullif(whole, F.lit(0))


def score_report(judged: DataFrame) -> DataFrame:
    """Counts and percentages in one row; percentages are null where nothing is left to divide by.

    `adjusted_accuracy` takes server errors and missing ground truths off the total one by one, so a row that is both
    is taken off twice; `adjusted_accuracy_distinct` takes it off once.
    """
    score = F.coalesce("judge_result.score", F.lit(0.0))
    reasoning = F.coalesce("judge_result.reasoning", F.lit(""))
    server_error = F.coalesce("answer", F.lit("")).contains(SERVER_ERROR)
    missing = F.lower(reasoning).contains(MISSING_TRUTH_ANY_CASE)
    for mark in MISSING_TRUTH:
        missing = missing | reasoning.contains(mark)
    correct = score >= CORRECT_THRESHOLD
    counts = judged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(correct).alias("correct"),
        F.count_if(~correct).alias("wrong"),
        F.count_if(server_error).alias("server_errors"),
        F.count_if(missing).alias("missing_ground_truth"),
        F.count_if(server_error | missing).alias("excluded"),
    )
    valid = F.col("total") - F.col("server_errors") - F.col("missing_ground_truth")
    valid_distinct = F.col("total") - F.col("excluded")
    return counts.select(
        "*",
        _percent(F.col("correct"), F.col("total")).alias("correct_pct"),
        _percent(F.col("wrong"), F.col("total")).alias("wrong_pct"),
        F.when(valid > 0, _percent(F.col("correct"), valid)).alias("adjusted_accuracy"),
        F.when(valid_distinct > 0, _percent(F.col("correct"), valid_distinct)).alias("adjusted_accuracy_distinct"),
    )
