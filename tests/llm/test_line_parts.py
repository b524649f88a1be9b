"""Pairs of lines are formed in parts of the buckets: each part alone, all of them together whole."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import lines
from tidemark.llm.common import WS_RUN


def test_parts_are_parts_and_lose_no_pair(spark):
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(120)]
    kept = []
    for _ in range(60):
        line = r.sample(vocab, 12)
        kept += [line, [*line[1:], "x"], [*line, "y"]]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(kept)], "doc_id bigint, text string")
    levels = lines.word_levels(docs, "text")
    records = lines.first_records(lines.word_sets(lines.exploded(docs, "doc_id", "text"), levels), 8, 10).withColumn("gone", F.lit(False)).localCheckpoint()
    parts = [{(x.ekey, x.lkey) for x in lines.open_pairs(records, 8, 10, k).collect()} for k in range(lines.PARTS)]
    sets = [set(w) for w in kept]
    near = {(a, b) for b in range(len(sets)) for a in range(b) if sets[a] != sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    every = set().union(*parts)
    assert len(near) > 100 and near <= every
    assert all(0 < len(p) < len(every) for p in parts)


def test_words_are_split_as_by_the_pattern(spark):
    texts = ["", " ", "a", " a  b\t\x0bc\x0c\r d\n", "\n\na b  c", "x\r\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_remove(lines._split(F.col("t")), "").alias("w"))
    assert {x.t: x.w for x in df.collect()} == {t: [w for w in re.split(WS_RUN, t) if w] for t in texts}
