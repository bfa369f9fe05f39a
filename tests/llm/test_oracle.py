from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from factloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = Q.queries()[name](spark, data)
    cur = con.cursor()
    cur.execute(Q.oracle_sql()[name])
    assert [x[0] for x in cur.description] == df.columns
    assert Counter(map(tuple, df.collect())) == Counter(cur.fetchall())
