import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from siltwork.plans import indexed
from siltwork.plans import queries as base
from tests.conftest import ROOT

QUERIES, SQL = base.QUERIES | indexed.QUERIES, base.SQL | indexed.SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_against_sql(spark, data, name):
    got = entry.queries()[name](spark, data).toPandas()
    if name not in SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    want = con.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (df[cols].sort_values(cols, ignore_index=True) for df in (got, want))
    assert len(a) == len(b)
    for c in cols:
        assert (a[c].fillna("~") == b[c].fillna("~")).all(), c


def test_entry(spark):
    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_llm(tmp_path):
    """With the subpackage and the pipeline gone the entry module imports and keeps the engine's queries."""
    shutil.copytree(f"{ROOT}/siltwork", tmp_path / "siltwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(SQL))], out.stderr
