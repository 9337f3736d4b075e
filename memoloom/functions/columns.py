"""Building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once, however often the body uses it, inside lambdas and CASE branches too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def explode_valid(values: Column, valid: Callable[[Column], Column]) -> Column:
    """One row per valid element. Unlike a filter afterwards, this does not compute the elements a second time."""
    return F.explode(F.filter(values, valid))
