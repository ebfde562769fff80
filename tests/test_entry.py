"""The driver's entry, with and without the llm subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from deltascope.plans.driver import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]


def rows_of(frame):
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    assert rows_of(QUERIES[name](spark, str(DATA)).toPandas()) == rows_of(con.execute(ORACLE[name]).fetchdf())


def test_entry(spark):
    if DATA.exists():
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_llm_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "deltascope", tmp_path / "deltascope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'partition_overview' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    if DATA.exists():
        code += f"""; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert all(q[n](s, {str(DATA)!r}).count() for n in ('partition_overview', 'breadth_by_day'))"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**{k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
