"""Every query with SQL against DuckDB on the smallest tables; the entry module without the corpus package."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from placebook.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def compare(spark, duck, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    found = duck.sql(sql)
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert ours == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, registry.QUERIES[name], registry.SQL[name])


def test_entry_works_without_the_corpus_package(tmp_path):
    """A copy of the repository without the corpus package still imports and lists its queries."""
    import shutil

    shutil.copytree(ROOT / "placebook", tmp_path / "placebook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'place_ranking' in q and not any(k[:2] == 'op' and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
