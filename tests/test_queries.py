"""Queries against their SQL in DuckDB on the smallest tables."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from wayloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    if name not in registry.SQL:
        assert df.count() > 0
        return
    want = duck.execute(registry.SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect()) == Counter(want.fetchall())


def test_entry_point_works_without_the_text_subpackage(tmp_path):
    root = Path(__file__).parent.parent
    (tmp_path / "wayloom").mkdir()
    for p in (root / "wayloom").iterdir():
        if p.name != "llm":
            (tmp_path / "wayloom" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = f"import sys; sys.path[:0] = ['{tmp_path}']; import importlib.util as u; s = u.spec_from_file_location('e', '{tmp_path}/__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), any(k.startswith('op1') for k in m.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert out.stdout.split()[-2:] == [str(len(registry.QUERIES)), "False"], out.stderr
