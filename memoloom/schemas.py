"""Row shapes and default values shared by sources, operators and jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# Categories a memory may carry. They document the vocabulary; rows with other values are kept.
CATEGORIES = ("preference", "fact", "decision", "entity", "other", "reflection")

# Scopes.
GLOBAL_SCOPE = "global"
USER_SCOPE_PREFIX = "user:"

# Defaults per producer.
DEFAULT_CATEGORY = "other"
IMPORTANCE_PAYLOAD = 0.7
IMPORTANCE_MARKDOWN_KNOWN = 0.8
IMPORTANCE_MARKDOWN_OTHER = 0.7
IMPORTANCE_TEXT = 0.6
IMPORTANCE_JSONL = 0.7
IMPORTANCE_RESULT = 0.6
IMPORTANCE_EXTRACTED = 0.5

# Search and grading parameters.
DEFAULT_TOP_K = 10
DEFAULT_MIN_SCORE = 0.3
CORRECT_THRESHOLD = 0.7

# A memory before embedding. `metadata` is a JSON object kept as text.
PAYLOAD = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

# A graded answer, as written by the judge job and read by the reports.
JUDGE_RESULT = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

# Questions with retrieved context and an answer.
QA_RESULT = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("category", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("context_ids", T.ArrayType(T.StringType())),
        T.StructField("answer", T.StringType()),
    ]
)

JUDGED_RESULT = T.StructType(QA_RESULT.fields + [T.StructField("judge_result", JUDGE_RESULT)])


def memory_schema(mode: str = "pro") -> T.StructType:
    """Schema of the stored memory table; `pro` carries scope, time and metadata, `basic` only a creation time."""
    common = [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("category", T.StringType()),
        T.StructField("importance", T.DoubleType()),
    ]
    if mode == "pro":
        extra = [
            T.StructField("timestamp", T.LongType()),
            T.StructField("scope", T.StringType()),
            T.StructField("metadata", T.StringType()),
        ]
    elif mode == "basic":
        extra = [T.StructField("createdAt", T.LongType())]
    else:
        raise ValueError(f"unknown memory table mode: {mode}")
    return T.StructType(common + extra)
