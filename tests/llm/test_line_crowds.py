"""Pairs of lines that are formed do not grow with the square of a group: unlike long lines, and near copies with edits of their own."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.llm import lines


def test_unlike_long_lines_are_not_paired(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in r.sample(range(400), 160))) for k in range(40)], "doc_id bigint, text string")
    levels = lines.word_levels(docs, "text")
    records = lines.first_records(lines.word_sets(lines.exploded(docs, "doc_id", "text"), levels), 8, 10).withColumn("gone", F.lit(False)).localCheckpoint()
    assert sum(lines.open_pairs(records, 8, 10, k).count() for k in range(lines.PARTS)) == 0


def test_near_copies_on_both_sides_of_the_longer_bits_are_found(spark):
    r = random.Random(3)
    base = [[f"b{k}x{x}" for x in range(lines.FEW_WORDS - 4 + k)] for k in range(9)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)] + [(100 + k, " ".join([*r.sample(w, len(w) - 3), *(f"e{k}y{y}" for y in range(8))])) for k, w in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(x.doc_id, x.line_no) for x in lines.repeated_lines(docs).collect()} == {(100 + k, 0) for k in range(9)}


def test_near_copies_are_settled_by_few_pairs(spark, monkeypatch):
    r = random.Random(1)
    edits = [f"e{k // 2}" for k in range(1200)]
    r.shuffle(edits)
    rows = []
    for k in range(600):
        words = [f"b{x}" for x in range(40)]
        for at, edit in zip(r.sample(range(40), 2), edits[2 * k : 2 * k + 2], strict=True):
            words[at] = edit
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made, write = {}, lines.Tables.write

    def counted(self, name, df):
        out = write(self, name, df)
        made[name] = out.count()
        return out

    monkeypatch.setattr(lines.Tables, "write", counted)
    assert sorted(x.doc_id for x in lines.repeated_lines(docs).collect()) == list(range(1, 600))
    assert sum(n for name, n in made.items() if name.startswith("met")) < 1200
