"""Every registered query against DuckDB, over whole tables."""

import pytest

import catalog
import oracle
from conftest import SF_DIR

catalog.load()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, duck, key):
    rows, problem = oracle.compare(spark, duck, key, SF_DIR)
    assert not problem
    assert rows > 0


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry_file

    df = entry_file.entry(spark)
    assert set(df.columns) == {"query_id", "context", "context_ids"}
    assert df.count() > 0
