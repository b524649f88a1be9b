"""Operator 1: secret scans with multipart credential linking.

Strong parts are reported wherever they stand.  Weak parts (account names, endpoints,
dense strings) are common in clean text, so they are reported only when complementary
parts co-occur in one scope: the parts of a text are joined by interval, ends sorted,
within a paragraph and a distance, and only the existence of a partner is asked for.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_ddl, map_batches, result_name

#: The base kinds in their order, then the weak kinds.
KINDS = ("assign", "access", "hex", "account", "endpoint", "dense")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ACCOUNT = re.compile(r"""\b(?:user(?:name|_?id)?|login|account|client_?id|access_?key_?id|tenant_?id)["']?[\x20\t]*[:=][\x20\t]*["']?([A-Za-z0-9][A-Za-z0-9._@-]{2,})""", re.ASCII | re.IGNORECASE)
ACCOUNT_HINTS = (b"user", b"login", b"account", b"client", b"access", b"tenant")
ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]{3,}|\b(?:host(?:name)?|endpoint|server|base_?url)["']?[\x20\t]*[:=][\x20\t]*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?""", re.ASCII | re.IGNORECASE)
ENDPOINT_HINTS = (b"://", b"host", b"endpoint", b"server", b"base")
DENSE = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: Letters of hex and of dense runs become 1, so that a run of some length is one substring search.
HEX_RUN = bytes(49 if chr(c) in "0123456789abcdef" else 48 for c in range(256))
DENSE_RUN = bytes(49 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_-") else 48 for c in range(256))
PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")

#: What each part of a credential is; a weak kind needs one part of each set beside it.
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "endpoint": "endpoint", "dense": "secret"}
NEEDS = {"account": ("secret",), "dense": ("identifier",), "endpoint": ("identifier", "secret")}

Span = tuple[str, int, int]


def base_spans(text: str, raw: bytes | None = None) -> list[Span]:
    """Spans (kind, start, end) of the strong kinds, in code points, leftmost and not overlapping in a kind."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out: list[Span] = []
    low = raw.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"1" * 24 in raw.translate(HEX_RUN):
        out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def weak_spans(text: str, raw: bytes, base: list[Span]) -> list[Span]:
    """Candidates of the weak kinds that no strong span covers."""
    low = raw.lower()
    out: list[Span] = []
    if any(h in low for h in ACCOUNT_HINTS):
        out += [("account", *m.span(1)) for m in ACCOUNT.finditer(text)]
    if any(h in low for h in ENDPOINT_HINTS):
        out += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if b"1" * 32 in raw.translate(DENSE_RUN):
        mixed = lambda x: any(c.isdigit() for c in x) and any(c.islower() for c in x) and any(c.isupper() for c in x)
        out += [("dense", *m.span()) for m in DENSE.finditer(text) if mixed(m[0])]
    starts = [s for _, s, _ in base]
    reach: list[int] = []
    for _, _, e in base:
        reach.append(max(e, reach[-1]) if reach else e)
    covered = lambda s, e: (k := bisect_left(starts, e)) > 0 and reach[k - 1] > s
    return [w for w in out if not covered(w[1], w[2])]


def link(text: str, base: list[Span], weak: list[Span], distance: int) -> tuple[list[Span], list[tuple[Span, Span]]]:
    """Weak spans with all their complements in scope, and each one's nearest complements.

    Two parts share a scope when they stand in one paragraph and at most ``distance`` code points lie
    between their starts.  The join is by binary search in the sorted starts of each part, so it lists no pairs.
    """
    breaks = [m.start() for m in PARAGRAPH.finditer(text)] if weak else []
    by_part: dict[str, list[Span]] = {"secret": [], "identifier": [], "endpoint": []}
    for s in sorted([*base, *weak], key=lambda s: s[1:]):
        by_part[PART[s[0]]].append(s)
    starts = {p: [s[1] for s in spans] for p, spans in by_part.items()}
    kept, links = [], []
    for w in weak:
        scope = bisect_right(breaks, w[1])
        low = max(w[1] - distance, breaks[scope - 1] if scope else 0)
        high = min(w[1] + distance, breaks[scope] if scope < len(breaks) else len(text))
        found = []
        for part in NEEDS[w[0]]:
            a, z = bisect_left(starts[part], low), bisect_right(starts[part], high)
            at = bisect_left(starts[part], w[1], a, z)
            near = [by_part[part][i] for i in (at - 1, at) if a <= i < z]
            if not near:
                break
            found.append(min(near, key=lambda s: abs(s[1] - w[1])))
        else:
            kept.append(w)
            links += [(w, f) for f in found]
    return kept, links


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 400) -> DataFrame:
    """Scan every whole text: key, ``base`` and ``spans`` (arrays of kind, start, end), ``links`` (weak part to partner).

    Offsets are code points, ends exclusive.  Base spans always stay; spans adds the linked weak ones.
    A null or empty text has none; repeated rows stay separate; an empty table gives no rows.  A key called
    like one of these comes out with an underscore behind it.
    """

    def start():
        def one(x: str | None):
            if not x:
                return [], [], []
            raw = x.encode("utf-8", "surrogatepass")
            base = base_spans(x, raw)
            weak = weak_spans(x, raw, base)
            kept, links = link(x, base, weak, distance) if weak else ([], [])
            return base, in_order(base + kept), links

        def each(b: dict[str, list]) -> dict[str, list]:
            rows = [one(x) for x in b["_text"]]
            as_dict = lambda s: {"kind": s[0], "start": s[1], "end": s[2]}
            return {
                "_id": b["_id"],
                "base": [[as_dict(s) for s in r[0]] for r in rows],
                "spans": [[as_dict(s) for s in r[1]] for r in rows],
                "links": [[{"part": as_dict(a), "partner": as_dict(z)} for a, z in r[2]] for r in rows],
            }

        return each

    span = "struct<kind: string, start: bigint, end: bigint>"
    slim = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    found = map_batches(slim, ["_id", "_text"], f"_id {field_ddl(slim, '_id')}, base array<{span}>, spans array<{span}>, links array<struct<part: {span}, partner: {span}>>", start)
    return found.withColumnRenamed("_id", result_name(key, "base", "spans", "links"))
