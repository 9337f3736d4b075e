"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memoloom.functions.columns import col, let


def l2_normalize(vector: Column | str) -> Column:
    """Unit-length vector of doubles; a zero vector stays zero."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))

    return let(col(vector).cast("array<double>"), scaled)


def hash_vector(text: Column | str, dimensions: int, seed: str = "") -> Column:
    """Pseudo-random components in [-1, 1) that depend on the text alone.

    The text is digested once; each further digest of that digest yields four components of 32 bits.
    """
    unit = 2.0**31

    def components(word: Column) -> Column:
        parts = [F.conv(F.substring(word, start, 8), 16, 10).cast("double") / unit - 1.0 for start in (1, 9, 17, 25)]
        return F.array(*parts)

    def words(digest: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.lit((dimensions + 3) // 4 - 1))
        return F.transform(
            numbers,
            lambda i: let(F.md5(F.concat_ws(":", F.lit(seed), i.cast("string"), digest).cast("binary")), components),
        )

    whole = let(F.md5(col(text).cast("binary")), lambda digest: F.flatten(words(digest)))
    return F.slice(whole, 1, dimensions)


def all_finite(vector: Column | str) -> Column:
    """Whether no component is null, NaN or infinite as a float; null for a null vector."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.forall(v.cast("array<float>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
