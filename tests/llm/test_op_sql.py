"""Every operator query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.llm import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", oracles.SQL)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    rel = con.execute(oracles.SQL[name])
    names = [c[0] for c in rel.description]
    columns = sorted(names)
    assert columns == sorted(df.columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rel.fetchall())
