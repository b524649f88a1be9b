"""What is published changes as a whole or not at all."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import published as pub

STATE = "name string, cash double, positions array<struct<id:bigint,side:string>>"


def state(spark, *names, cash=1.0):
    return spark.createDataFrame([(n, cash, [(k, "long") for k in range(2)]) for n in names], STATE).repartition(4)


def test_versions_follow_each_other(spark, tmp_path):
    at = f"file://{tmp_path}/book"
    assert pub.versions(at) == [] and pub.current(spark, at, STATE).count() == 0
    pub.publish(state(spark, "a", "b"), at)
    old = pub.current(spark, at, STATE)
    pub.publish(old.withColumn("cash", F.col("cash") + 1).unionByName(state(spark, "é", cash=5.0)), at, base=1)
    assert pub.versions(at) == [1, 2]
    assert sorted((r.name, r.cash, len(r.positions)) for r in pub.current(spark, at, STATE).collect()) == [("a", 2.0, 2), ("b", 2.0, 2), ("é", 5.0, 2)]
    assert sorted(r.name for r in old.collect()) == ["a", "b"]  # a reader of the old version isn't disturbed
    for e in pub.manifest(at):
        body = (tmp_path / "book" / e["path"]).read_bytes()
        assert (e["bytes"], e["sha256"], e["rows"]) == (len(body), hashlib.sha256(body).hexdigest(), body.count(b"\n"))
    pub.publish(state(spark, "z").limit(0), at)
    assert pub.manifest(at) == [] and pub.current(spark, at, STATE).count() == 0
    pub.forget(at, 1)
    assert pub.versions(at) == [3] and not [d for d in os.listdir(tmp_path / "book") if d.startswith("data")]


def test_a_failing_task_changes_nothing_readable(spark, tmp_path):
    at = str(tmp_path / "book")
    pub.publish(state(spark, "a"), at)
    before = {p: p.read_bytes() for p in (tmp_path / "book").rglob("*") if p.is_file()}
    bad = state(spark, *"bcdefgh").withColumn("cash", F.when(F.col("name") == "h", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("cash")))
    with pytest.raises(Exception, match="broken"):
        pub.publish(bad, at)
    after = {p: p.read_bytes() for p in (tmp_path / "book").rglob("*") if p.is_file() and p.name != pub.PARTIAL}
    assert after == before and [r.name for r in pub.current(spark, at, STATE).collect()] == ["a"]
    partial = json.loads((tmp_path / "book" / pub.PARTIAL).read_text())
    assert partial["after_version"] == 1 and partial["ended"] < partial["tasks"]
    pub.publish(state(spark, "i"), at)
    assert pub.versions(at) == [1, 2]


def test_two_writers_of_one_version(spark, tmp_path):
    """Both read version 1; the second to publish must read again."""
    at = str(tmp_path / "book")
    pub.publish(state(spark, "a"), at)
    pub.publish(state(spark, "first"), at, base=1)
    with pytest.raises(Exception, match="StaleVersion"):
        pub.publish(state(spark, "second"), at, base=1)
    assert [r.name for r in pub.current(spark, at, STATE).collect()] == ["first"] and pub.versions(at) == [1, 2]


def test_files_with_their_manifest(spark, tmp_path):
    at = str(tmp_path / "pages")
    rows = [(f"c{k % 3}/page_{k:03d}.md", f"# Page {k}\n\nText é" if k else None) for k in range(30)]
    pub.publish(spark.createDataFrame(rows, "path string, content string").repartition(3), at, kind="files")
    entries = pub.manifest(at)
    assert len(entries) == 30 and entries == sorted(entries, key=lambda e: e["path"])
    for (path, text), e in zip(sorted(rows), entries, strict=True):
        assert e["path"].endswith(path) and (tmp_path / "pages" / e["path"]).read_text() == (text or "") and e["sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    for wrong in ("../x", "/x", "a/../b", ""):
        with pytest.raises(Exception, match="can't be called"):
            pub.publish(spark.createDataFrame([(wrong, "x")], "path string, content string"), at, kind="files")
    with pytest.raises(Exception, match="path and content"):
        pub.publish(state(spark, "a"), at, kind="files")
    assert pub.versions(at) == [1]
