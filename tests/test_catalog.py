"""Every registered interval query against its SQL, and the entry without the corpus operators."""

import math
import os
import subprocess
import sys

import pytest

from spanloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def test_all_queries_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    cursor = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    expected = sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in cursor.fetchall()), key=repr)
    assert sorted(df.columns) == names
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == expected
    assert all(t.split("<")[0] not in ("array", "map", "struct") for _, t in df.dtypes)


def test_interval_plans_have_no_python_and_few_exchanges(spark):
    df = catalog.queries()["o53_cluster"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # frames once, everything after once


def test_entry_without_corpus_operators(tmp_path):
    """The driver may remove the corpus operators; the entry still imports and has all other queries."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
