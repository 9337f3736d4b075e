"""Search hits as users see them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoloom.functions import jsons
from memoloom.schemas import GLOBAL_SCOPE


def normalize_hits(df: DataFrame) -> DataFrame:
    """Metadata parsed to VARIANT (kept as a string value when it is not JSON), scope and score defaulted."""
    changes = {}
    if "metadata" in df.columns:
        changes["metadata"] = F.coalesce(jsons.parse("metadata"), F.col("metadata").cast("variant"))
    if "scope" in df.columns:
        changes["scope"] = F.coalesce("scope", F.lit(GLOBAL_SCOPE))
    if "score" in df.columns:
        changes["score"] = F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))
    return df.withColumns(changes)


def filter_min_score(df: DataFrame, min_score: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= F.lit(min_score))
