"""The driver's contract, without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_catalogue_and_sql_agree():
    from rollmill.plans import catalogue

    assert len(catalogue.QUERIES) > 100 and set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_core_imports_without_the_subpackage():
    code = "import sys; sys.modules['rollmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('p1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
