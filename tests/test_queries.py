"""Every registered query of the retrieval operators against its SQL on the small tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from rankforge.plans import registry


def plain(v):
    if v is None or v != v:
        return "NULL"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for t in os.listdir(folder):
        con.sql(f"create view {t.split('.')[0]} as select * from '{folder}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, sql, name):
    frame = registry.QUERIES[name](spark, sf_dir)
    expected = sql.sql(registry.ORACLE_SQL[name])
    columns = sorted(expected.columns)
    assert columns == sorted(frame.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    at = [expected.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_imports_without_the_llm_package():
    code = """
import sys
sys.modules["rankforge.llm"] = sys.modules["corpus_pipeline"] = None
import __spark_entry__ as entry
from rankforge.plans import registry
assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLE_SQL)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root})
