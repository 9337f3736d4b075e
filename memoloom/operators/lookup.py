"""Joining many rows to a table with one row per key, when some keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key wanted in one task; keys with more are spread over several.
ROWS_PER_PART = 100_000
# Keys spread at most. A key beyond the largest 100,000 holds less than 1/100,000 of the rows and stays whole.
MAX_SPREAD_KEYS = 100_000


def lookup(
    rows: DataFrame, table: DataFrame, on: str, spread: Column, how: str = "inner", rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """`rows` joined to `table`, which has one row per value of `on`.

    Keys with more than `rows_per_part` rows are split by `spread`, a number that differs between rows of a key, and
    their table row is repeated for each part. Only these keys, a bounded number of short rows, are broadcast; without
    any it comes to a plain join. Nothing is counted before the result is asked for.
    """
    counts = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.where(F.col("_rows") > rows_per_part).orderBy(F.desc("_rows")).limit(MAX_SPREAD_KEYS)
    hot = F.broadcast(hot.select(on, F.ceil(F.col("_rows") / rows_per_part).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, on, "left").withColumn("_part", F.pmod(spread, parts).cast("int")).drop("_parts")
    right = table.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [on, "_part"], how).drop("_part")
