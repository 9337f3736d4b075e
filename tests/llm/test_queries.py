"""The registered queries: one for each operator, against SQL where SQL can express them, and leaving no trace outside."""

import subprocess
import sys
from pathlib import Path

import pytest

import oracle
from conftest import SF_DIR
from memoloom.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[2]


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_against_sql(spark, key):
    rows, problem = oracle.compare(spark, oracle.connect(SF_DIR), key, SF_DIR)
    assert not problem and rows > 0


def test_rest_of_the_library_works_without(tmp_path):
    """A copy without the subpackage and the pipeline still imports, with all other queries."""
    for name in ("memoloom", "catalog"):
        for file in (ROOT / name).rglob("*.py"):
            if "llm" not in file.relative_to(ROOT).parts:
                target = tmp_path / file.relative_to(ROOT)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(file.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    for file in (ROOT / "memoloom").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "memoloom.llm" not in file.read_text()
