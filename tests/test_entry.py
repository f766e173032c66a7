"""The driver's contract: names, the flagship query, and life without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in sql.values())


@pytest.mark.skipif(not SMALL.exists(), reason="no test data here")
def test_flagship(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_core_stands_without_the_llm_subpackage():
    code = "import sys; sys.modules['harborline.llm'] = None; import __spark_entry__ as e; names = set(e.queries()); assert names and not names & {'p1_found', 'p7_ids', 'p8_mixture', 'p9_found'}; assert 'p4_found' in names"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_nothing_outside_imports_llm():
    for path in [*ROOT.glob("harborline/**/*.py")]:
        if "llm" not in path.parts:
            assert "harborline.llm" not in path.read_text(), path
