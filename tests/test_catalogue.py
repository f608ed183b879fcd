"""Every query against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from sparkloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows, order):
    return sorted(([round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalogue.oracle_sql():
        assert df.columns
        return
    found = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    names = sorted(df.columns)
    assert plain(rows, [df.columns.index(c) for c in names]) == plain(found.fetchall(), [found.columns.index(c) for c in names])


def test_entry_imports_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['sparkloom.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=100).returncode == 0


def test_flagship_pushes_its_columns_down(spark):
    plan = catalogue.queries()["bm25_search"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Python" not in plan
