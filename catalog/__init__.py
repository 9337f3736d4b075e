"""Registered queries: every operator and job over the supplied tables, with the SQL that must give the same rows."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # model clients run inside tasks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its key, and the SQL it is checked against."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from catalog import evaluation, jobs, parsing, rows, scans, searches  # noqa: F401
