"""Registered queries against their SQL, and the package without its optional part."""

import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from skylode.plans import oracle, registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(value):
    if isinstance(value, np.ndarray):
        return [plain(v) for v in value]
    if isinstance(value, float) and value != value:
        return None
    return value.item() if hasattr(value, "item") else value


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    got = registry.queries()[name](spark, sf_dir).toPandas()
    expected = con.execute(oracle.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[columns].astype(object).where(df[columns].notna(), None).values)
    assert rows(got) == rows(expected)


def test_the_rest_stands_without_the_optional_folders(tmp_path):
    shutil.copytree(f"{ROOT}/skylode", tmp_path / "skylode", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 25 and set(o) <= set(q); assert not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
