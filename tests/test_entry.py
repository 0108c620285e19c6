"""The driver's contract, and a few queries against their SQL on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from evigraph.plans import registry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(q.__doc__ for q in registry.queries().values())


def test_core_imports_without_the_text_package():
    code = "import sys; sys.modules['evigraph.llm'] = None; import __spark_entry__ as e; assert 'p7_ids' not in e.queries() and 'p2_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)


def test_nothing_imports_the_text_package():
    root = Path(entry.__file__).parent / "evigraph"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "evigraph.llm" not in p.read_text(), p


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["p2_found", "offset_recovery", "factual_support", "graph_edges", "resolver_status", "job_trace", "smart_ranges"])
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())
