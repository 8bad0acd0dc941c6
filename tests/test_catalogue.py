import glob
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewire import catalogue

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df):
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        out[c] = out[c].map(lambda v: "" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_is_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    pd.testing.assert_frame_equal(plain(got), plain(duck.execute(catalogue.ORACLES[name]).df()))


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "edition_pos"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    """Without the corpus subpackage the entry point and all other queries are there."""
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "tidewire", ".git"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.makedirs(tmp_path / "tidewire")
    for name in os.listdir(f"{ROOT}/tidewire"):
        if name != "llm":
            os.symlink(f"{ROOT}/tidewire/{name}", tmp_path / "tidewire" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q14_edition' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
