from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(k for k in registered.oracle_sql() if k.startswith("q_")))
def test_query_equals_sql(spark, duck, data, name):
    got = registered.queries()[name](spark, data).toPandas()
    want = duck.sql(registered.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert {k for k in registered.queries() if k.startswith("q_")} == {k for k in registered.oracle_sql() if k.startswith("q_")}


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_results_dont_depend_on_partitions(spark, data):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    name = "q_flagship_run_report"
    a = rows(registered.queries()[name](spark, data).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(registered.queries()[name](spark, data).toPandas()) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repository_is_whole_without_extras(tmp_path):
    """A copy without the training-data operators imports, and runs its queries."""
    copy = tmp_path / "repo"
    shutil.copytree(os.path.dirname(registered.__file__), copy, ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 48 and set(q) == set(e.oracle_sql()) and all(k.startswith('q_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True)
