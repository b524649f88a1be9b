"""Tables in the shared folder, and their end."""

from __future__ import annotations

import os

import pytest

from tidemark.llm import codes, common


def test_tables_end(spark):
    vectors = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [2.0] * 16, 1)], "vec_id bigint, embedding array<float>, label int")
    got, _ = codes.compress(vectors)
    assert got.count() == 2
    tables = common.Tables(spark)
    kept = tables.write("a", vectors)
    folder = tables.top.removeprefix("file://")
    assert os.path.isdir(folder) and kept.count() == 2
    assert common.clear_tables(spark) >= 2 and not os.path.isdir(folder) and common.clear_tables(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|No such file"):
        spark.read.parquet(tables.top + "/a").count()
