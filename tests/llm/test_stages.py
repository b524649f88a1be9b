"""Stages of the pipeline and thin queries on a small written fixture: whole rows against brute force."""

from __future__ import annotations

import collections
import random
import zlib

import public_tokenizers
import pytest
from test_operators import LOW, TERM, classes, near_lines, water_fill, words

import corpus_pipeline
from tidemark.llm import queries, tokens

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = [[r.choice(vocab) for _ in range(60)] for _ in range(12)]
    out = []
    for k in range(60):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 3, 12))):
            w[r.randrange(60)] = r.choice(vocab)
        text = "".join(x + (r.choice("\n ")) for x in w)
        out.append((k, text, "en", r.choice("aab"), len(text)))
    return [*out, (900, None, "en", "a", 0), (901, "", "de", "b", 0)]


@pytest.fixture(scope="module")
def items(rows):
    return [(k, " ".join(words(rows[k * 7][1])[5:25])) for k in range(3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows, items):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


def test_near_copies(spark, rows, folder):
    least = {i for i, _, c in classes(rows, 5, 8, 10) if i == c}
    got = bag(corpus_pipeline.near_copies(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    assert got == collections.Counter(x for x in rows if x[0] in least) and len(least) < len(rows)


def test_decontaminate(spark, rows, items, folder):
    grams = lambda x: {tuple(w[k : k + 10]) for w in [TERM.findall((x or "").translate(LOW))] for k in range(len(w) - 9)}
    held = set().union(*(grams(t) for _, t in items))
    got = bag(corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    want = collections.Counter(x for x in rows if not grams(x[1]) & held)
    assert got == want and 0 < len(want) < len(rows)


def test_mix_sources(spark, rows, folder):
    got = bag(corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    want = water_fill(sizes, [5.0, 2.0, 1.0], 1.5, 2)
    assert set(got) <= {x for x in rows if words(x[1])} and max(got.values()) <= 2
    taken = collections.Counter()
    for x, n in got.items():
        taken[x[3]] += n * len(words(x[1]))
    # one document at the end of each source's stream is taken in part, and rounded
    assert all(abs(taken[s] - want[s]) <= 31 for s in want), (taken, want)


def test_shard_and_op9(spark, rows, folder):
    size = {i: len((t or "").encode()) + 8 for i, t, *_ in rows}
    for out in (corpus_pipeline.shard(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), queries.op9_byte_shards(spark, folder)):
        got = sorted(out.collect(), key=lambda r: r.doc_id)
        assert [(r.doc_id, r.size, r.text_crc32) for r in got] == [(i, size[i], zlib.crc32((t or "").encode())) for i, t, *_ in rows]
        assert [(r.shard, r.slot) for r in got] == sorted((r.shard, r.slot) for r in got)


def test_op2(spark, rows, folder):
    gone = near_lines(rows)
    want = collections.Counter()
    for i, t, *_ in rows:
        parts = (t or "").split("\n")
        out = tuple(k for k in range(len(parts)) if (i, k) in gone)
        want[i, len(parts), len(out), out, None if t is None else "\n".join(x for k, x in enumerate(parts) if k not in out)] += 1
    got = collections.Counter((r.doc_id, r.n_lines, r.n_removed, tuple(r.removed), r.text) for r in queries.op2_line_dedup(spark, folder).collect())
    assert got == want


def test_op3(spark, rows, folder):
    assert bag(queries.op3_ngram_jaccard(spark, folder)) == collections.Counter(classes(rows, 3, 90, 100))


def test_op4(spark, rows, folder):
    c = tokens.PrefixCounter(public_tokenizers.path(queries.TOKENIZER))
    want = collections.Counter()
    for i, t, *_ in rows:
        n = c.count(t) if t else 0
        want[i, len((t or "").encode()), n, n > 1024, len(t or "")] += 1
    assert bag(queries.op4_token_counts(spark, folder)) == want
