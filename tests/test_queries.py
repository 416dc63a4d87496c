"""Every registered report query against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from quillgrid.plans.oracle import ORACLE_SQL
from quillgrid.plans.queries import QUERIES

KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=str)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    mine = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    kinds = {c[0]: str(c[1]) for c in found.description}
    assert sorted(mine.columns) == sorted(columns)
    assert {c: KINDS[k] for c, k in mine.dtypes} == kinds
    got = rows(mine.columns, mine.collect())
    assert got == rows(columns, found.fetchall())
    assert got


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:4] == ["company_id", "indicator", "unit", "year"] and df.count() > 0
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_year_filter_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["q06_results"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(p_type,ECONOMY)" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_without_training_operators(tmp_path):
    """A copy without the training operators, their tests and the pipeline still imports and lists its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root, copy = Path(__file__).resolve().parent.parent, tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'pipeline' not in q and len(q) == len(s) > 40 and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True, timeout=120)
