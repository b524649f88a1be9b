"""Approximate quotes against a search over all runs of words."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tidemark.functions import fuzzy
from tidemark.operators import wiki


def every_run(quote, text):
    """Each run of each size is compared."""
    if len(quote) < 6 or len(text) < 6:
        return False
    for size in range(max(6, int(len(quote) * 0.75)), min(len(text), int(len(quote) * 1.6) + 6) + 1):
        for i in range(len(text) - size + 1):
            if SequenceMatcher(None, " ".join(quote), " ".join(text[i : i + size])).ratio() >= 0.82:
                return True
    return False


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_end_distances_and_common_lengths():
    r = random.Random(1)
    for _ in range(60):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(1, n))) for n in (12, 25))
        want = [min(edit_distance(a, b[i : j + 1]) for i in range(j + 2)) for j in range(len(b))]
        assert fuzzy.end_distances(a, b) == want
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
        assert fuzzy.common_length(fuzzy._places(a), len(a), b) == grid[-1][-1]


def changed(r, words, n):
    words = list(words)
    for _ in range(n):
        k = r.randrange(len(words))
        words[k] = r.choice((words[k][::-1], words[k] + "s", "other", words[k][:-1] or "a"))
    return words


def cases(seed, n):
    """Quotes of one to many changed words, cut, stretched, and of other texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeionrstldm") for _ in range(r.randint(1, 8))) for _ in range(60)]
    for _ in range(n):
        text = [r.choice(vocab) for _ in range(r.choice((5, 8, 20, 40)))]
        size = r.choice((4, 6, 9, 14))
        at = r.randrange(max(1, len(text) - size))
        quote = changed(r, text[at : at + size], r.choice((0, 1, 1, 2, 3, 5, 9))) if r.random() < 0.85 else [r.choice(vocab) for _ in range(size)]
        yield quote, text


def test_found_as_by_comparing_every_run():
    found = []
    for quote, text in cases(3, 250):
        found.append(fuzzy.fuzzy_found(quote, text))
        assert found[-1] == every_run(quote, text), (quote, text)
    assert 40 < sum(found) < 220


def test_long_runs_follow_the_matcher_to_the_letter():
    """Above 200 characters the matcher leaves out frequent characters; the bounds must not find more than it does."""
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(200)]
    for n in (1, 3, 8):
        text = [r.choice(vocab) for _ in range(60)]
        quote = changed(r, text[5:45], n)
        assert fuzzy.fuzzy_found(quote, text) == every_run(quote, text)


def test_found_quotes_with_their_fuzzy_half(spark):
    rows = [(f"p{k}", 1, " ".join(q), f"raw/{k}.md", " ".join(t)) for k, (q, t) in enumerate(cases(5, 120))]
    sourced = spark.createDataFrame([r[:4] for r in rows], "path string, start int, quote string, raw_path string")
    raw = spark.createDataFrame([(r[3], r[4]) for r in rows], "path string, text string")
    got = {x.path: x.found for x in wiki.found_quotes(sourced, raw).collect()}
    for path, _, quote, _, text in rows:
        q = quote.split()
        exact = quote in text or any(" ".join(q[i : i + 6]) in text for i in range(len(q) - 5))
        head = " ".join(w for w in q if len(w) > 1)
        assert got[path] == (exact or (head != "" and " ".join(head.split()[:12]) in text) or every_run(q, text.split())), path
    exact_only = sourced.join(raw.withColumnRenamed("path", "raw_path"), "raw_path").where(F.contains("text", "quote")).count()
    assert exact_only < sum(got.values()) < len(rows)


def test_changed_quotes_of_documents(spark, tmp_path):
    """The query's quotes, each against every run of its document."""
    from tidemark.plans import corpus

    r = random.Random(11)
    vocab = ["".join(r.choice("aeionrstldm") for _ in range(r.randint(2, 9))) for _ in range(80)]
    docs = [(k, " ".join(r.choice(vocab) for _ in range(r.choice((3, 12, 16, 30, 45))))) for k in range(60)] + [(60, None), (61, ""), (62, "!!")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(x.path): x.found for x in corpus.t06_changed_quotes(spark, str(tmp_path)).collect()}
    want = {}
    for k, text in docs:
        w = (text or "").replace("!", "").split()
        at = max(len(w) // 2 - 8, 1) - 1
        quote = [x if (i % 3 != 2 if k % 3 == 2 else i % 5 != 4) else (x + "s", x[::-1], "other", x)[k % 4] for i, x in enumerate(w[at : at + 16])]
        exact = bool(quote) and (" ".join(quote) in " ".join(w) or any(" ".join(quote[i : i + 6]) in " ".join(w) for i in range(len(quote) - 5)) or " ".join(quote[:12]) in " ".join(w))
        want[k] = exact or every_run(quote, w)
    assert got == want and 20 < sum(got.values()) < 55


def test_a_quote_in_its_place_needs_no_pass(monkeypatch):
    """A quote with changed words is found where its other words stand, without a pass over the text."""
    monkeypatch.setattr(fuzzy, "end_distances", lambda *_: (_ for _ in ()).throw(AssertionError("the whole text was passed")))
    r = random.Random(3)
    text = ["".join(r.choice("aeionrstldm") for _ in range(r.randint(2, 8))) for _ in range(400)]
    for at in (0, 1, 200, 384):
        assert fuzzy.fuzzy_found([w + "s" if k % 5 == 4 else w for k, w in enumerate(text[at : at + 16])], text)
