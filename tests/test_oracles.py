"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tidemark.plans import corpus, evaluation, evidence, logs, market, records, review, runs

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CASES = [(m, name) for m in (market, evaluation, corpus, evidence, records, review, logs, runs) for name in m.SQL]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_matches_sql(spark, duck, module, name):
    df = module.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    rel = duck.execute(module.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(plain(r[names.index(c)])) for c in columns) for r in rel.fetchall())
    assert got == want
