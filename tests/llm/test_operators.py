"""The corpus operators against brute force, with odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import collections
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, contamination, jaccard, lines, mixing, normalise, quality, queries, secrets, shards, tokens, toxicity

DATA = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, n string, `key` string, shard string, token string, columns string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def make(spark, rows):
    """Documents with extra columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, lang, s in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Texts with near copies of many kinds, repeats, nulls, empty, short and long ones."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdeéßfgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows = [(0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t", None, None), (3, "one", "en", None), (4, "One", "en", "b"), (5, "one two", "en", "b"), (6, "one two", "de", "b")]
    base = [[r.choice(vocab) for _ in range(r.choice((12, 30, 60, 150)))] for _ in range(25)]
    for k in range(220):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
            w[r.randrange(len(w))] = r.choice(vocab)
        text = "".join(x + (r.choice("\n\n  ") if r.random() < 0.15 else " ") for x in w)
        rows.append((10 + k, text, r.choice(("en", "de")), r.choice("aab")))
    rows.append((900, " ".join(r.choice(vocab) for _ in range(20_000)), "en", "c"))
    rows += [rows[20], rows[20], rows[2]]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return make(spark, corpus).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, []).limit(0)


def words(x):
    return WORD.findall(x or "")


# 1

def test_secrets(spark, none):
    k = "AKIA" + "A1" * 10
    texts = {
        1: "password: hunter2hunter user=bob", 2: 'Token = "0123456789abcdef0123456789abcdef"', 3: f"x {k} y\nuser: admin1 host: db.example.com", 4: "https://example.com/a user: bob", 5: None, 6: "ſecret=abcdefg secret=abc api_key:'A.b-c=/+'",
        7: f"user: bob1\n\n{k}", 8: "client_id=abc123 " + "Ab1" * 12, 9: "é" * 5 + "passwd=é123456 passwd=1234567",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    kinds = lambda i, c: [s.kind for s in got[i][c]]
    assert kinds(1, "base") == ["assign"] and kinds(1, "spans") == ["assign", "account"]
    assert kinds(2, "base") == ["assign", "hex"]
    assert kinds(3, "spans") == ["access"]  # an account needs a secret, an endpoint both
    assert kinds(4, "spans") == [] and kinds(5, "spans") == []
    assert kinds(6, "base") == ["assign"] and [texts[6][s.start : s.end] for s in got[6].base] == ["api_key:'A.b-c=/+"]
    assert kinds(7, "spans") == ["access"]
    assert kinds(8, "spans") == ["account", "dense"] and len(got[8].links) == 2
    assert [(s.start, s.end) for s in got[9].base] == [(20, 34)]
    assert secrets.scan(none).count() == 0


# 2

def near_lines(corpus, num=8, den=10):
    gone, seen = set(), []
    for i, t, *_ in sorted({(i, t) for i, t, *_ in corpus}, key=lambda x: x[0]):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if s:
                if any(den * len(s & o) >= num * len(s | o) for o in seen):
                    gone.add((i, k))
                seen.append(s)
    return gone


def test_line_dedup(spark, corpus, none):
    unique = list({r[0]: r for r in corpus}.values())
    df = make(spark, unique)
    got = {(r.doc_id, k) for r in lines.without_repeats(df).collect() for k in r.removed}
    assert got == near_lines(unique) and got
    row = lines.without_repeats(df).where("n_removed > 0").first()
    text = dict((i, t) for i, t, *_ in unique)[row.doc_id]
    assert row.text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in row.removed)
    assert lines.without_repeats(none).count() == 0


# 3

def classes(corpus, width, num, den):
    sets = {}
    for n, (i, t, *_) in enumerate(corpus):
        w = words((t or "").translate(LOW))
        sets[n] = frozenset(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, *_) in enumerate(corpus):
        least[find(n)] = min(i, least.get(find(n), i))
    return sorted((i, len(sets[n]), least[find(n)]) for n, (i, *_) in enumerate(corpus))


@pytest.mark.parametrize(("width", "num", "den", "block"), [(3, 90, 100, 1024), (5, 8, 10, 1024), (2, 7, 10, 4)])
def test_near_classes(docs, corpus, width, num, den, block):
    got = jaccard.near_classes(docs, width, num, den, block=block)
    want = classes(corpus, width, num, den)
    assert sorted(map(tuple, got.collect())) == want
    assert len({c for _, _, c in want}) < len({i for i, *_ in want}) - 5


def test_one_of_each(docs, corpus, none):
    want = {i for i, _, c in classes(corpus, 5, 8, 10) if i == c}
    got = [r.doc_id for r in jaccard.one_of_each(docs).select("doc_id").collect()]
    assert sorted(got) == sorted(want)
    assert jaccard.near_classes(none).count() == 0
    assert jaccard.one_of_each(docs).columns == docs.columns


def test_threshold_bounds():
    t = jaccard.Threshold(9, 10)
    assert t.alone(8) and not t.alone(9)
    a = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[:95], a[:5] + np.uint64(1)])
    size = min(len(jaccard.parity(a)), len(jaccard.parity(b)))
    assert (jaccard.fold(jaccard.parity(a), size) ^ jaccard.fold(jaccard.parity(b), size)).bit_count() <= 10


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (101, 100)], "a int, b int")
    assert {(r.node, r.label) for r in components.components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components.components(chain.limit(0)).count() == 0


# 4

ODD = ["a   b", "a \n\n  b c", "it's they're 'really' 'l 'la 'll !!'s", "x<|endoftext|>y z<|endoftext|><|endoftext|>  q", "  ", "\n", "", "é è 日本語 😀😀 ñ", "aaaa" * 30, " " * 200 + "x", "\t\t\n x", "foo  <|endoftext|>  bar", "\x1c\x1d a \x85 b", "don't 'd've", "ֈ ҈ ᭠", "a" * 3000]


def test_prefix_counts():
    c = tokens.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    for t in [*ODD[:-1], *("".join(r.choice("ab 's\n\té😀!1<|> ") for _ in range(r.randint(0, 14))) for _ in range(400))]:
        assert np.cumsum(np.frombuffer(c.changes(t), "<i2")).tolist() == [c.count(t[: i + 1]) for i in range(len(t))], t


def test_token_columns(spark, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, *ODD])], "doc_id int, text string")
    c = tokens.PrefixCounter(path)
    for r in tokens.prefix_counts(df, path).select("doc_id", "n_bytes", tokens.n_tokens().alias("n"), tokens.fits(5).alias("fits"), tokens.tokens_before(3).alias("three")).collect():
        t = ([None, *ODD][r.doc_id]) or ""
        assert (r.n_bytes, r.n, r.three) == (len(t.encode()), c.count(t) if t else 0, c.count(t[:3]) if t else 0)
        assert r.fits == max([k for k in range(min(len(t), 40) + 1) if not k or c.count(t[:k]) <= 5]) or len(t) > 40
    assert tokens.prefix_counts(none, path).count() == 0


# 5

def test_quality_counts(docs, corpus, none):
    want = []
    for i, x, *_ in corpus:
        w = words(x)
        own = [p for p in (x or "").split("\n") if words(p)]
        g = list(zip(w, w[1:], w[2:], strict=False))
        n = collections.Counter(g)
        cover = {k + j for k, z in enumerate(g) if n[z] > 1 for j in range(3)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(own) - len(set(own)), len(cover)))
    got = quality.base_counts(docs.drop("n")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert quality.judge(none).count() == 0


def test_sketch_is_close(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("v"), (F.col("id") % 2).alias("g"))
    b = df.select("v", "g", quality.bucket(F.col("v")).alias("bucket")).withColumn("low", quality.bucket_low(F.col("bucket")))
    assert b.where("low > v or v - low > v / 32").count() == 0
    assert b.groupBy("bucket").agg((F.min("v") == F.min("low")).alias("same"), (F.max("v") >= F.max("low")).alias("over")).where("not over").count() == 0


def sketch_brute(rows, keys):
    """Fences of each group by plain Python: (lang, source, value of symbols_per_mille) in, high fences out."""
    low = lambda v: v if v < 64 else (v >> (v.bit_length() - 6)) << (v.bit_length() - 6)
    own = {k: collections.Counter() for k in keys}
    for lang, source, v in rows:
        own[lang, source][low(v)] += quality.UNIT

    def mix(a, parent):
        total = sum(parent.values())
        return a + collections.Counter({v: int(w / total * float(quality.PRIOR * quality.UNIT)) for v, w in parent.items()})

    every = sum(own.values(), collections.Counter())
    out = {}
    for lang, source in keys:
        mine = sum((c for (x, _), c in own.items() if x == lang), collections.Counter())
        c = mix(own[lang, source], mix(mine, every))
        total = sum(c.values())
        at = lambda q: next(v for v in sorted(c) if 1000 * sum(w for x, w in c.items() if x <= v) >= q * total)  # noqa: E731, B023
        _, tail, reach = quality.METRICS["symbols_per_mille"]
        out[lang, source] = at(tail) + reach * (sum(w * abs(v - at(500)) for v, w in c.items()) // total)
    return out


def test_fences_follow_the_group(spark):
    r = random.Random(9)
    rows = [("en", "code", r.randint(60, 140)) for _ in range(500)] + [("en", "prose", r.choice((0, 0, 0, 1, 2))) for _ in range(500)] + [("de", "prose", r.choice((0, 5))) for _ in range(40)] + [("de", None, 900), (None, None, 3)]
    df = spark.createDataFrame(rows, "lang string, source string, symbols_per_mille bigint").withColumns({m: F.lit(0).cast("bigint") for m in quality.METRICS if m != "symbols_per_mille"})
    got = {(x.lang, x.source): x.fence.symbols_per_mille.high for x in quality.group_fences(df).collect()}
    assert got == sketch_brute(rows, list(got)) and len(got) == 5
    assert got["en", "code"] > 2 * got["en", "prose"] and got["de", None] < 900


def test_quality_drops_junk_only(spark):
    r = random.Random(5)
    clean = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(120)), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in clean[i][1].split()), "en", "s") for i in range(20)]
    got = {x.doc_id: x.kept for x in quality.judge(make(spark, clean + junk).withColumns({c: F.lit("x") for c in ("_lang", "gl", "af", "_words", "row", "Kept", "fence", "metric", "w")})).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


# 6

def test_toxicity_on_held_out(spark):
    r = random.Random(11)
    vocab = ["w%d" % i for i in range(600)]
    bad = ["vile", "awful", "nasty"]

    def text(toxic):
        w = [r.choice(vocab) for _ in range(80)]
        if toxic:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(80)] = r.choice(bad)
        return " ".join(w)

    rows = [(i, text(i % 8 == 0), "en", "s") for i in range(1600)]
    df = make(spark, [*rows, (5000, None, "en", "s"), (5001, "", "en", "s")])
    labels = spark.createDataFrame([(i, 1 - (i % 16 == 0), int(i % 8 == 0)) for i in range(800)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit(df, toxicity.categorised(labels), ["low_quality", "toxic"])
    p = {x.doc_id: x.p_toxic for x in toxicity.score(df, chain, ["doc_id"]).collect()}
    assert sum((p[i] >= 0.5) == (i % 8 == 0) for i in range(800, 1600)) >= 792
    assert p[5000] == p[5001] < 0.5
    kept = {x.doc_id for x in toxicity.clean(df, chain).collect()}
    assert kept == {i for i, x in p.items() if x < 0.5}
    assert toxicity.clean(df, chain).columns == df.columns
    flat = toxicity.fit(df, toxicity.categorised(labels.limit(0)), ["low_quality", "toxic"])
    assert toxicity.score(df.limit(0), flat, ["doc_id"]).count() == 0 and toxicity.clean(df, flat, below=0.9).count() == 1602


# 7

def water_fill(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * w[s] for s in order}
        full |= over


def test_mix(docs, corpus, none):
    uses, taken = mixing.mix(docs, [5.0, 2.0, 1.0], block_tokens=64)
    sizes = collections.Counter()
    for _, t, _, s in corpus:
        sizes[s] += len(words(t))
    want = water_fill(sizes, [5.0, 2.0, 1.0], 1.5, 2)
    rows = taken.collect()
    got = collections.Counter()
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        got[r.source] += r.taken
    assert all(abs(got[s] - want[s]) <= 1 for s in want)
    used = uses.groupBy("slot").agg(F.sum("words").alias("n")).collect()
    assert max(r.n for r in used) <= 64
    again = mixing.mix(docs, [5.0, 2.0, 1.0], block_tokens=64)[1].collect()
    key = lambda x: sorted((r.key, r.taken) for r in x)
    assert key(rows) == key(again)
    assert mixing.mix(none, [1.0])[1].count() == 0
    m = mixing.mixed(docs, [5.0, 2.0, 1.0])
    assert m.columns == docs.columns and m.where("doc_id = 0").count() == 0


# 8

def test_normaliser_reads_any_gzip():
    recs = [normalise.record("response", str(i), "http://x/\n", ("p%d" % i).encode() * i, "d", None) for i in range(0, 3000, 500)]
    whole = gzip.compress(b"".join(recs[:3])) + gzip.compress(b"".join(recs[3:]))
    out = io.BytesIO()
    index = list(normalise.normalise(io.BytesIO(whole), out))
    data = out.getvalue()
    assert [zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) for e in index] == recs
    assert gzip.decompress(data) == b"".join(recs)
    with pytest.raises(ValueError):
        list(normalise.normalise(io.BytesIO(gzip.compress(recs[1][:-9])), io.BytesIO()))


def test_members_by_a_plain_parser(spark, tmp_path):
    """Every member is one WARC/1.1 record with the mandatory headers and an id of its own, read here without the operator's reader."""
    rows = [(1, "u1", "é" * 700), (1, "u1", "é" * 700), (2, "u2", "é" * 700), (3, None, None), (None, "u", "x: y\r\n\r\nz")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert normalise.round_trip(df, per_archive=2, folder=f"file://{tmp_path}/w").count() == 5
    seen, blocks, files = [], [], sorted((tmp_path / "w").glob("*.members.warc.gz"))
    for f in files:
        raw = f.read_bytes()
        assert not [p for p in (tmp_path / "w").glob("*.part")]
        while raw:
            d = zlib.decompressobj(31)
            data, raw = d.decompress(raw) + d.flush(), d.unused_data
            head, _, rest = data.partition(b"\r\n\r\n")
            first, *fields = head.decode().split("\r\n")
            h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in fields)
            assert first == "WARC/1.1" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", h["WARC-Record-ID"])
            assert rest[int(h["Content-Length"]) :] == b"\r\n\r\n" and h["WARC-Type"] in ("response", "revisit")
            seen.append(h["WARC-Record-ID"])
            blocks.append(rest[: int(h["Content-Length"])])
            assert h["WARC-Type"] == "revisit" or hashlib.sha1(blocks[-1]).hexdigest() == h["WARC-Payload-Digest"].removeprefix("sha1:")
    assert len(set(seen)) == 5 and sorted(b for b in blocks if b) == sorted([("é" * 700).encode(), b"x: y\r\n\r\nz"])


def test_warc_round_trip(spark, none):
    big = "é" * 700
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "x" * 1000), (8, "a\r\nb", "x" * 999 + "\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("x"))
    for few in (200_000, 0):
        normalise.FEW_TWINS = few
        got = {r.page_id: r for r in normalise.round_trip(df, per_archive=3).collect()}
        assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3)} | {i: ("response", None) for i in (3, 4, 5, 6, 7, 8)}
        for i, _, h in rows:
            b = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
    normalise.FEW_TWINS = 200_000
    assert normalise.round_trip(df.limit(0)).count() == 0


# 9

def test_shards(docs, corpus, none):
    rows = shards.byte_shards(docs, 5).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    ends = [(min(r.doc_id for r in v), max(r.doc_id for r in v)) for _, v in sorted(by.items())]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert shards.byte_shards(none, 5).count() == 0


def test_shards_are_even(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    total = [r.n for r in shards.byte_shards(df, 24).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(total) == 24 and max(total) - min(total) <= 2 * 58


# 10

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_contamination(spark, docs, corpus, none, block_bytes):
    r = random.Random(2)
    long = [t for _, t, *_ in corpus if t and len(words(t)) > 40]
    items = [(k, " ".join(words(r.choice(long))[5 : 5 + r.choice((4, 10, 25))]).upper().replace(" ", ", ")) for k in range(12)] + [(50, None), (51, "!!"), (52, "zz qq"), (53, "one")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    wins = collections.defaultdict(set)
    low = lambda x: TERM.findall((x or "").translate(LOW))
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t, *_ in corpus:
        w, hit, found = low(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    found |= wins[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        want.append((i, len(w), len(hit), ",".join(sorted(found))))
    got = contamination.matches(docs, bench, block_bytes=block_bytes).select("doc_id", "n_words", contamination.hit_words().cast("long").alias("n"), F.array_join("item_ids", ",").alias("items"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(n for *_, n, _ in want)
    clean = contamination.clean(docs, bench, block_bytes=block_bytes)
    assert sorted(x.doc_id for x in clean.collect()) == sorted(i for i, _, n, _ in want if not n)
    assert contamination.matches(none, bench).count() == 0
    assert contamination.matches(docs, bench.limit(0)).agg(F.sum(F.size("item_ids"))).first()[0] == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "x b y a z c"), (2, "a b c"), (3, "a q q q q q b c"), (4, "a b")], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert {r.doc_id for r in contamination.matches(d, bench, slop=2).where("size(item_ids) > 0").collect()} == {1, 2}
    assert {r.doc_id for r in contamination.matches(d, bench).where("size(item_ids) > 0").collect()} == {2}


# queries and pipeline

def test_all_queries_are_named():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    have = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns
            got = {r.doc_id for r in out.select("doc_id").collect()}
            assert got <= have and len(got) > 0.5 * len(have)
            have, docs = got, spark.createDataFrame(out.collect(), out.schema)
        else:
            assert {r.doc_id for r in out.collect()} == have
