"""Vector codes, conversation repair and winnowed fingerprints against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes, queries, turns, winnow

# 11

VECTOR = "vec_id bigint, embedding array<float>, label int, codes string, q string, `of` string, error string, label_error string"


def vectors(spark, rows):
    """Vectors with extra columns whose names clash with those that the operator adds."""
    return spark.createDataFrame([(i, v, label, *"xxxxx") for i, v, label in rows], VECTOR).repartition(3)


def coded(rows, parts, entries, rounds):
    """Plain Python: all entries are compared."""
    kept = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = lambda q: [tuple(q[p * width : (p + 1) * width]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(q)[p] for _, _, q in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, v: min((far(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            took = {}
            for _, _, q in kept:
                took.setdefault(nearest(p, cut(q)[p])[1], []).append(cut(q)[p])
            new.append([tuple(sum(c) // len(took[k]) for c in zip(*took[k], strict=True)) if k in took else e for k, e in enumerate(books[p])])
        books = new
    found = [(i, label, [nearest(p, cut(q)[p]) for p in range(parts)]) for i, label, q in kept]
    errors = {}
    for _, label, f in found:
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    return sorted((i is None, i or 0, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label]) for i, label, f in found), books


@pytest.mark.parametrize(("n", "grain"), [(300, 0.01), (260, 0.5), (20, 0.01)])
def test_codes_equal_brute_force(spark, n, grain):
    """Coarse grains give many equal entries and distances; few vectors give short codebooks."""
    r = random.Random(n)
    rows = [(r.randrange(10_000) - 5000, [round(r.gauss(0, 1) / grain) * grain for _ in range(16)], r.choice((None, 1, 2))) for _ in range(n)]
    rows += [(None, [0.5] * 16, 1), (None, [-0.25] * 16, None), rows[0], rows[0], (9, None, 1), (10, [float("nan")] * 16, 1), (11, [float("inf"), *[0.0] * 15], 2), (12, [None, *[0.0] * 15], 2)]
    got, books = codes.compress(vectors(spark, rows), parts=4, entries=24, rounds=2)
    want, want_books = coded(rows, 4, 24, 2)
    assert sorted((x.vec_id is None, x.vec_id or 0, x.code, x.error, x.label_error) for x in got.withColumn("code", codes.hex_code(F.col("codes"))).collect()) == want
    assert [list(map(tuple, b)) for b in books.tolist()] == want_books


def test_codes_of_odd_tables(spark):
    got, books = codes.compress(vectors(spark, []).limit(0))
    assert got.count() == 0 and codes.book_text(books) == ""
    assert codes.compress(vectors(spark, [(1, None, 1)]))[0].count() == 0
    one, _ = codes.compress(vectors(spark, [(1, [1.0] * 32, None)]))
    assert [(x.codes, x.error, x.label_error) for x in one.collect()] == [([0] * 16, 0, 0)]
    with pytest.raises(ValueError, match="one length"):
        codes.compress(vectors(spark, [(1, [1.0] * 15, 1)]))


def test_tree_finds_the_lowest_of_equal_entries():
    r = np.random.default_rng(5)
    for spread in (1, 2, 5, 1000):
        entries = r.integers(-spread, spread + 1, (64, 3))
        points = r.integers(-spread - 1, spread + 2, (500, 3))
        index, squares = codes.Tree(entries).nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(index, every.argmin(axis=1)) and np.array_equal(squares, every.min(axis=1))


# 12

TALK = "conv_id bigint, turn bigint, role string, text string, n string, fault string, audit string, seen string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def talks(spark, rows):
    return spark.createDataFrame([(*r, *"xxxx") for r in rows], TALK).repartition(3)


def cheapest(rows):
    """Dijkstra over (rows done, state) with whole audits; rows are (role, text, fault)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, out = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(out)
        for role in ("user", "assistant"):
            if role[0] in after[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", k, role[0], (*out, f"{role}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state, out))
            if fault in (None, "truncated"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in after[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, role[:1], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in after[state]:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", k + 1, new[0], (*out, f"{new}:{text}")))
    raise AssertionError


def mended(rows):
    """Plain Python of the whole contract."""
    by = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    found = []
    for conv, had in by.items():
        had.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).hexdigest()))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in had:
            marks = BLANK.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                counts[fault] += 1
        at = {t for t, *_ in had if t is not None}
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, text = cheapest(judged)
        found.append((str(conv), max(at) - min(at) + 1 - len(at) if at else 0, *counts.values(), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found)


def odd_talks(seed, n=120):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        length = r.choice((1, 2, 3, 4, 6, 9))
        for k in range(length):
            turn = r.choice((k, k, k, k + 3, None, 1))
            role = r.choice(("system" if k == 0 else "user", "user" if k % 2 else "assistant", "user", "assistant", r.choice((None, "", "tool", "umpire"))))
            rows.append((conv, turn, role, r.choice(("Hello there.", "What?", "no end", "", " \n", None, "Yes!\n", " .", f"Text {r.random()}."))))
    return rows + rows[:9] + [(500, None, None, None), (501, 1, "assistant", "a" * 50_000 + ".")]


def test_repair_equals_brute_force(spark):
    rows = odd_talks(256)
    audited, repaired = turns.repair(talks(spark, rows))
    sha = {str(x.conv_id): x.repaired_sha256 for x in turns.digests(repaired).collect()}
    got = sorted((str(x.conv_id), x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, sha.get(str(x.conv_id), hashlib.sha256(b"").hexdigest())) for x in audited.collect())
    assert got == mended(rows)
    kept = {}
    for x in sorted(repaired.collect(), key=lambda x: (str(x.conv_id), x.place)):
        kept.setdefault(str(x.conv_id), []).append(x)
    for conv, xs in kept.items():
        assert re.fullmatch("s?(ua)+", "".join(x.role[:1] for x in xs)) and [x.place for x in xs] == list(range(len(xs)))
        assert "".join(x.edit for x in xs) == next(g[7] for g in got if g[0] == conv).replace("D", "")


def test_segments_and_batches_change_nothing(monkeypatch):
    """The walks of one task, cut after every row, every two, and not at all."""
    r = random.Random(6)
    rows = [(conv, k, r.choice((1, 1, 1, 2, 0 if k == 0 else 1)), r.choice("suuaaax"), r.choice((None, None, "blank", "duplicate", "truncated"))) for conv in range(80) for k in range(r.choice((1, 3, 7, 12)))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["conv_id", "turn", "n", "initial", "fault"])
    seen = []
    for segment, size in ((256, 8192), (1, 1), (2, 5), (3, 40)):
        monkeypatch.setattr(turns, "SEGMENT", segment)
        monkeypatch.setattr(turns, "BATCH", size)
        seen.append(sorted(x for b in turns._audits(iter([batch.slice(0, 100), batch.slice(100)])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)))
    assert len(seen[0]) == 80 and all(x == seen[0] for x in seen)
    for conv, *_, cost, audit in seen[0]:
        mine = [(i if i != "x" else "", "", f if not copy else "blank" if f == "blank" else "duplicate") for c, _, n, i, f in rows if c == conv for copy in range(n)]
        assert cheapest([({"s": "system", "u": "user", "a": "assistant"}.get(i, i), t, f) for i, t, f in mine])[:2] == (cost, audit)


def test_repair_of_a_long_conversation(spark):
    r = random.Random(3)
    rows = [(7, k, r.choice(("user", "assistant")), f"Turn {k}" + r.choice((".", ""))) for k in range(1200)]
    audited, repaired = turns.repair(talks(spark, rows))
    row = audited.first()
    assert (row.cost, row.audit) == mended(rows)[0][6:8] and turns.digests(repaired).first().repaired_sha256 == mended(rows)[0][8]


def test_repair_of_no_rows(spark):
    audited, repaired = turns.repair(talks(spark, []).limit(0))
    assert audited.count() == 0 and repaired.count() == 0 and turns.digests(repaired).count() == 0


def test_repair_query_keeps_dropped_conversations(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi."), (gone + 2000, 5, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x.conv_id: x for x in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert (got[gone].cost, got[gone].audit, got[gone].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest()) and len(got) == 2


# 13

def plain_hash(gram):
    h = 0
    for c in gram:
        h = (h * winnow._BASE + ord(c) + 1) % 2**64
    h ^= h >> 33
    return h * 0xFF51AFD7ED558CCD % 2**64 >> 32


def winnowed(text, k, w):
    """Every window looked at: the least hash, of equal ones the rightmost."""
    if not text:
        return []
    k = min(k, len(text))
    h = [plain_hash(text[i : i + k]) for i in range(len(text) - k + 1)]
    w = min(w, len(h))
    picked = {min(range(s, s + w), key=lambda i: (h[i], -i)) for s in range(len(h) - w + 1)}
    return [(i, h[i]) for i in sorted(picked)]


def listed(found):
    return list(zip(found[0].tolist(), found[1].tolist(), strict=True))


def test_winnowing_equals_brute_force(monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(winnow, "PIECE", 100)
    texts = ["", "a", "ab", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "héllo 🌊 wörld " * 9, *("".join(r.choice("ab \U0001f30a") for _ in range(r.randint(1, 700))) for _ in range(40))]
    for k, w in ((1, 1), (3, 4), (5, 9), (12, 39), (7, 1), (16, 8)):
        for t in texts:
            assert listed(winnow.fingerprint(t, k, w)) == winnowed(t, k, w), (k, w, len(t))


def test_shared_passages_share_a_gram():
    r = random.Random(2)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(60):
        passage = some(winnow.GRAM + winnow.WINDOW - 1)
        a, b = some(r.randint(0, 300)) + passage + some(r.randint(0, 300)), some(r.randint(0, 300)) + passage + some(r.randint(0, 300))
        assert set(winnow.fingerprint(a)[1].tolist()) & set(winnow.fingerprint(b)[1].tolist())


def pages(spark, rows):
    return spark.createDataFrame([(i, t, *"xxxxx") for i, t in rows], "doc_id bigint, text string, id string, at string, `range` string, head string, places string").repartition(5)


def alike(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("n", [1, 2, 150])
def test_fingerprints_equal_brute_force(spark, n):
    r = random.Random(n)
    rows = [(r.randrange(-300, 300), "".join(r.choice("abc é🌊") for _ in range(r.choice((0, 1, 3, 50, 400))))) for _ in range(n)]
    rows += [(None, "null id " * 9), (None, None), (5, "twin" * 20), (5, "twin" * 20), (5, None), (5, ""), (1000, "x" * 30_000)] if n > 2 else []
    got = winnow.compared(pages(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        e = t[: len(t) - q] + u[:q]
        p, ep = winnowed(t, winnow.GRAM, winnow.WINDOW), winnowed(e, winnow.GRAM, winnow.WINDOW)
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), p, ep, alike(p, ep), alike(p, winnowed(u, winnow.GRAM, winnow.WINDOW))))
    zipped = lambda p, h: list(zip(p, h, strict=True))
    assert sorted((str(x.id), x.n_chars, x.edited_sha256, zipped(x.places, x.hashes), zipped(x.edited_places, x.edited_hashes), x.near_edited, x.near_next) for x in got) == sorted(want)


def test_fingerprints_of_odd_tables(spark):
    assert winnow.compared(pages(spark, []).limit(0)).count() == 0
    named = spark.createDataFrame([("b", "one text"), ("a", "another"), (None, "third")], "doc_id string, text string")
    got = {x.id: x.edited_sha256 for x in winnow.compared(named).collect()}
    assert got["a"] == hashlib.sha256(b"anotheo"[:6] + b"o").hexdigest() and len(got) == 3
    shown = winnow.fingerprints(pages(spark, [(1, None), (2, "abc")])).orderBy("doc_id").collect()
    assert [x.places for x in shown] == [[], [0]] and shown[0].id == "x"
