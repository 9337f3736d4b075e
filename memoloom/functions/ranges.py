"""Number selections such as '1-4', '3', '1,3,5' or 'all'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoloom.functions.columns import col
from memoloom.functions.text import strip

_PART = r"^\d+(\s*-\s*\d+)?$"


def _bounds(spec: Column | str) -> Column:
    """Array of (lo, hi), null for no restriction. A part that is neither a number nor a range is an error."""
    spec = col(spec)
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda p: p != "")
    checked = F.transform(
        parts,
        lambda p: F.when(p.rlike(_PART), p).otherwise(
            F.raise_error(F.concat(F.lit("not a number or range: "), p)).cast("string")
        ),
    )
    bounds = F.transform(
        checked,
        lambda p: F.struct(
            strip(F.substring_index(p, "-", 1)).cast("bigint").alias("lo"),
            strip(F.substring_index(p, "-", -1)).cast("bigint").alias("hi"),
        ),
    )
    return F.when((F.coalesce(spec, F.lit("")) != "") & (F.lower(spec) != "all"), bounds)


def range_members(spec: Column | str) -> Column:
    """The selected numbers, sorted and distinct; null when everything is selected."""
    members = F.transform(
        F.filter(_bounds(spec), lambda b: b["lo"] <= b["hi"]), lambda b: F.sequence(b["lo"], b["hi"])
    )
    return F.array_sort(F.array_distinct(F.flatten(members)))


def in_range(number: Column | str, spec: Column | str) -> Column:
    """Whether the selection holds the number. The selection is not spelled out, so its width does not matter."""
    n = col(number)
    bounds = _bounds(spec)
    return bounds.isNull() | F.exists(bounds, lambda b: n.between(b["lo"], b["hi"]))


def filter_numbers(df: DataFrame, number: str, spec: str | None) -> DataFrame:
    """Keep the rows whose number is selected."""
    if not spec:
        return df
    return df.where(in_range(number, F.lit(spec)))
