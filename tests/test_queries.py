"""Every query with SQL against DuckDB, and the entry without the subpackage llm."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import densika.queries as engine

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def value(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", engine.SQL)
def test_against_sql(spark, duck, name):
    ours = engine.QUERIES[name](spark, DATA)
    theirs = duck.execute(engine.SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    expected = sorted(tuple(map(value, r)) for r in theirs.fetchall())
    assert sorted(tuple(map(value, r)) for r in ours.select(*(f"`{c}`" for c in columns)).collect()) == expected


def test_queries_without_sql(spark):
    assert set(engine.QUERIES) - set(engine.SQL) == {"stage_trace"}
    found = engine.QUERIES["stage_trace"](spark, DATA).collect()
    assert found and all(r["seconds"] > 0 and r["n_rows"] >= 0 for r in found)


def test_components_of_all_lineitem_edges(spark, duck):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in duck.execute("SELECT l_orderkey, l_orderkey + l_suppkey FROM lineitem").fetchall():
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = engine.QUERIES["union_find"](spark, DATA).collect()
    assert sorted(map(tuple, found)) == sorted((x, root(x)) for x in parent)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 19
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "densika", tmp_path / "densika", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dbscan_labels' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": ""}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
