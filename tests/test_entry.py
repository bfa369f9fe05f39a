"""Every query of the core runs on the smallest scale and agrees with its SQL; the rest stands without the subpackage llm."""

from __future__ import annotations

import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from factloom.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def cell(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    cur = duck.cursor()
    cur.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert Counter(tuple(cell(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stands_without_llm():
    code = "import sys; sys.modules['factloom.llm'] = None; import __spark_entry__ as e; assert e.llm is None and not any(q.startswith('p1_') for q in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_imports_llm():
    for p in (ROOT / "factloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace("__spark_entry__", "")
