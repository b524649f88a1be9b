"""Operator 2 with null and repeated keys, against brute force over rows."""

from __future__ import annotations

import collections

import pytest

from tidemark.llm import lines

SHARED = "a line that several of the documents hold"
NEAR = "one two three four five six seven eight nine ten"
ROWS = {
    "null key": [(None, f"only here and nowhere else\n{SHARED}\n\n{NEAR}"), (1, f"{SHARED}\nfirst of its own"), (2, f"second of its own words\n{SHARED}\n{NEAR} more")],
    "repeated row": [(1, f"{SHARED}\nfirst of its own"), (1, f"{SHARED}\nfirst of its own"), (2, f"{SHARED}\nsecond text with other words"), (None, None), (None, "")],
    "null row repeated": [(None, f"{SHARED}\nalone in the null rows"), (None, f"{SHARED}\nalone in the null rows"), (3, f"{SHARED}\nthird")],
}


def brute(rows):
    seen, out = [], []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        gone = []
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(line.split())
            if s and any(10 * len(s & o) >= 8 * len(s | o) for o in seen):
                gone.append(k)
            if s:
                seen.append(s)
        left = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        out.append((key, tuple(gone), left))
    return out


@pytest.mark.parametrize("case", ROWS)
def test_rows_keep_one_copy_of_each_line(spark, case):
    docs = spark.createDataFrame(ROWS[case], "doc_id bigint, text string").repartition(3)
    got = collections.Counter((r.doc_id, tuple(r.removed), r.text) for r in lines.without_repeats(docs).collect())
    assert got == collections.Counter(brute(ROWS[case]))
    gone = collections.Counter((r.doc_id, r.line_no) for r in lines.repeated_lines(docs).collect())
    assert gone == collections.Counter((key, k) for key, removed, _ in brute(ROWS[case]) for k in removed)


def test_one_key_of_unlike_texts_keeps_each_line_once(spark):
    docs = spark.createDataFrame([(7, f"{SHARED}\nleft side words"), (7, f"{SHARED}\nother words on the right")], "doc_id bigint, text string")
    left = "\n".join(r.text for r in lines.without_repeats(docs).collect()).split("\n")
    assert sorted(x for x in left if x) == sorted([SHARED, "left side words", "other words on the right"])
