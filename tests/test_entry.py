"""The driver's contract: every query against its SQL, and the library without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "NULL" if v != v else f"{v:.6g}"
    if v is None or v is pd.NaT or v is pd.NA:
        return "NULL"
    if hasattr(v, "tolist") and not isinstance(v, (int, str)):
        v = v.tolist()
    return repr([normal(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(normal(v) for v in r) for r in df.values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def names():
    from memspark.plans.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from memspark.plans.queries import ORACLES, QUERIES

    got = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert rows(got.toPandas()) == rows(duck.execute(ORACLES[name]).fetch_df())
    else:
        assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "hash", "score", "result_type", "rank", "source"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage(tmp_path):
    """Everything else imports when the subpackage and the pipeline are gone."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(repo, "memspark"), tmp_path / "memspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(repo, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 80 and not any(x.startswith('op') for x in n) and 'pipeline' not in n; print(len(n))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
