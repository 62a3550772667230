"""The driver contract."""

import os

import pytest

SMALL = "/root/testdata/sf0.001"


def test_queries_and_statements_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_core_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys; import lodestitch.queries.catalog as c; c.registries(); assert not any(m.startswith('lodestitch.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
