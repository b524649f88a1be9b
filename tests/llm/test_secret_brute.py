"""op1_secret_scan, whole rows, against nested loops over random texts."""

from __future__ import annotations

import hashlib
import random
import re

from tidemark.llm import queries, secrets

CASED = "".join  # keywords in either case, of ASCII letters only
KEYS = ["password", "passwd", "secret", "token", "api_?key"]
ANY_CASE = "|".join(CASED(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in KEYS)
BASE = {"assign": re.compile(rf"(?:{ANY_CASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), "access": re.compile("(AKIA[A-Z0-9]+)"), "hex": re.compile("([0-9a-f]+)")}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def text_of(r):
    """Parts of credentials, whole and broken, strewn over words, lines and paragraphs."""
    some = lambda chars, low, high: "".join(r.choice(chars) for _ in range(r.randint(low, high)))
    parts = [
        lambda: r.choice(["password", "PassWd", "SECRET", "token", "apikey", "API_KEY", "ſecret", "api-key"]) + r.choice(["", '"', "'"]) + r.choice([":", " = ", "=", " ", ":\t"]) + r.choice(["", '"']) + some("aB3+/_.=-é", 3, 10),
        lambda: "AKIA" + some("ABC019", 12, 20) + r.choice(["", "x"]),
        lambda: some("0123456789abcdef", 20, 30) + r.choice(["", "G"]),
        lambda: r.choice(["user", "Login", "account", "client_id"]) + r.choice([": ", "=", " "]) + some("abcé12.", 2, 8),
        lambda: r.choice(["https://", "redis://", "host: ", "endpoint="]) + some("abc", 3, 5) + "." + some("de", 2, 3),
        lambda: some("aB3+/", 28, 40),
        lambda: r.choice(["\n", "\n\n", "\n \t\n", " ", "é𝄞", "x" * r.choice((5, 200, 398, 402))]),
        lambda: " ".join(some("abcdeß", 1, 6) for _ in range(r.randint(1, 8))),
    ]
    return r.choice(["", " ", "\n"]).join(r.choice(parts)() + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 25)))


def brute(text):
    order = list(secrets.KINDS).index
    base = [(k, m.start(), m.end()) for k, pattern in BASE.items() for m in pattern.finditer(text) if len(m[1]) >= LEAST[k]]
    weak = [("account", *m.span(1)) for m in secrets.ACCOUNT.finditer(text)] + [("endpoint", *m.span()) for m in secrets.ENDPOINT.finditer(text)]
    weak += [("dense", *m.span()) for m in secrets.DENSE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    weak = [w for w in weak if not any(w[1] < b[2] and b[1] < w[2] for b in base)]
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    paragraph = lambda at: sum(b <= at for b in breaks)
    near = lambda w, part: any(secrets.PART[s[0]] == part and abs(s[1] - w[1]) <= 400 and paragraph(s[1]) == paragraph(w[1]) for s in base + weak)
    kept = [w for w in weak if all(near(w, part) for part in secrets.NEEDS[w[0]])]
    shown = lambda spans: ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (s[1], order(s[0]), s[2])))
    n = [sum(b[0] == k for b in base) for k in BASE]
    return (*n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + kept))


def test_op1_whole_rows(spark, tmp_path):
    r = random.Random(11)
    texts = [None, "", "password=abcdef", "password=abcdef"] + [text_of(r) for _ in range(1500)] + ["word " * 50_000 + "secret: zzzzzzz user=bob"]
    spark.createDataFrame([(i // 2 if i < 4 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_secret_scan(spark, str(tmp_path))
    want = sorted((i // 2 if i < 4 else i, *brute(t or "")) for i, t in enumerate(texts))
    assert sorted(tuple(x[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) for x in got.collect()) == want
    linked = sum("account" in w[-1] or "endpoint" in w[-1] or "dense" in w[-1] for w in want)
    assert 100 < linked < len(want)
