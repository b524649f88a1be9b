"""What op2 holds on the driver and makes again is small: levels are bytes, and each check on whole sets makes them once."""

from __future__ import annotations

import random

from pyspark.sql import types as T

from tidemark.llm import lines


def test_levels_are_a_byte_a_cell(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id bigint, text string")
    levels = lines.word_levels(docs, "text")
    assert levels.schema["levels"].dataType.elementType == T.ByteType()
    got = levels.first()["levels"]
    assert len(got) == lines.CELLS and sorted(x for x in got if x) == [lines.STEPS]


def test_sets_are_made_once_for_all_lines_and_once_a_check(spark, monkeypatch):
    r = random.Random(5)
    base = [f"b{k}" for k in range(30)]
    rows = [(k, " ".join([*r.sample(base, 28), f"e{k}"])) for k in range(150)] + [(200, "x1 x2 x3 x4 x5 x6 x7 x8 x9"), (201, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").localCheckpoint()
    sets = [set(t.split()) for _, t in rows]
    near = {rows[b][0] for b in range(len(sets)) if any(10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for a in range(b))}
    made, written, make, write = [], [], lines.word_sets, lines.Tables.write
    monkeypatch.setattr(lines, "word_sets", lambda *a: made.append(1) or make(*a))
    monkeypatch.setattr(lines.Tables, "write", lambda self, name, df: written.append(name) or write(self, name, df))
    assert {x.doc_id for x in lines.repeated_lines(docs).collect()} == near and 201 in near and len(near) > 140
    assert len(made) == 3 and sum(x.startswith("sets") for x in written) == 2
