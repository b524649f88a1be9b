"""Keys and texts called like columns that the operators use or add."""

from __future__ import annotations

import pytest

from tidemark.llm import contamination, jaccard, secrets, shards

TEXTS = {1: "password: hunter2hunter one two three four five six seven eight nine ten eleven", 2: "short", 3: None, 4: "password: hunter2hunter one two three four five six seven eight nine ten eleven", 5: "short"}


def named(spark, key, text="text"):
    return spark.createDataFrame(list(TEXTS.items()), f"`{key}` bigint, `{text}` string").repartition(2)


@pytest.mark.parametrize(("key", "out"), [("base", "base_"), ("_text", "_text")])
def test_secrets(spark, key, out):
    got = secrets.scan(named(spark, key, "_id"), key, "_id")
    assert {r[out]: len(r["base"]) for r in got.collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0}


@pytest.mark.parametrize(("key", "out"), [("component_id", "component_id_")])
def test_near_classes(spark, key, out):
    got = jaccard.near_classes(named(spark, key, "_id"), 3, 90, 100, key, "_id")
    assert {r[out]: r["component_id"] for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2}


def test_one_of_each(spark):
    kept = jaccard.one_of_each(named(spark, "print", "prefix"), 3, 90, 100, "print", "prefix")
    assert kept.columns == ["print", "prefix"] and sorted(r[0] for r in kept.collect()) == [1, 2, 3]


@pytest.mark.parametrize(("key", "out"), [("_part", "_part"), ("_total", "_total"), ("size", "size_")])
def test_shards(spark, key, out):
    got = sorted((r[out], r["size"], r["shard"], r["slot"]) for r in shards.byte_shards(named(spark, key), 2, [key]).collect())
    assert [g[1] for g in got] == [len(TEXTS[k] or "") + 8 for k in sorted(TEXTS)] and {g[2] for g in got} == {0, 1}


@pytest.mark.parametrize(("key", "out"), [("hits", "hits_"), ("_c1", "_c1")])
def test_contamination(spark, key, out):
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine ten"), (None, "short")], "item_id bigint, text string")
    got = contamination.matches(named(spark, key), items, carry=(key,))
    assert {r[out]: r["item_ids"] for r in got.collect()} == {1: ["7"], 2: [""], 3: [], 4: ["7"], 5: [""]}
    both = contamination.matches(named(spark, key), items, carry=(key, "text"), block_bytes=1)
    assert {r[out]: (r["text"], r["item_ids"]) for r in both.collect()} == {k: (t, {1: ["7"], 4: ["7"], 3: []}.get(k, [""])) for k, t in TEXTS.items()}
