"""Operator 4: exact token counts at every prefix of a text.

For a byte-level BPE the encoding of a prefix is found by dynamic programming over the
positions of a pre-token: the last token of the prefix that ends at ``i`` is the one
vocabulary entry ``t`` ending there that the encoder keeps next to the last token of the
prefix that ends at ``i - len(t)``; the count is that prefix's count plus one.  The
counts of all prefixes are stored as differences, so the token count of a text, of any
prefix, and the longest prefix within a budget are read off without encoding again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from .common import field_ddl, map_batches

#: The endings that the byte-level pre-tokenizer splits off as units.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Pre-tokens kept per worker; beyond it the memo starts anew (only speed depends on it).
MEMO = 180_000
#: Characters that are split here, by a pattern equal to the library's; texts with any other are split by the library itself.
PLAIN = "\t\n\r\x20-\x7e\xa1-\u024f\u0391-\u03a1\u03a3-\u03ff\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
USUAL = re.compile(f"[{PLAIN}]*").fullmatch


def _class(initial: str) -> str:
    """The characters of PLAIN in a general category, as ranges of a character class."""
    bounds = [(ord(m[1]), ord(m[2] or m[1])) for m in re.finditer("(.)(?:-(.))?", PLAIN, re.DOTALL)]
    found = [c for a, z in bounds for c in range(a, z + 1) if unicodedata.category(chr(c))[0] == initial]
    edges = [k for k in range(len(found)) if not k or found[k] != found[k - 1] + 1]
    return "".join(f"{chr(found[a])}-{chr(found[z - 1])}" for a, z in zip(edges, [*edges[1:], len(found)], strict=True))


#: The byte-level pre-tokenizer's pattern for texts of PLAIN, words first as they are most (no unit below starts like one).
LETTERS, DIGITS = _class("L"), _class("N")
PIECE = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{DIGITS}]+| ?[^\\s{LETTERS}{DIGITS}]+|\\s+(?!\\S)|\\s+")


def _changes(ends: list[int]) -> bytes:
    return array("h", map(int.__sub__, ends, [0, *ends[:-1]])).tobytes()


class PrefixCounter:
    """Prefix token counts for one tokenizer file; counts are those of the library's ``encode``."""

    def __init__(self, path: str) -> None:
        self.tok = Tokenizer.from_file(path)
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        known = json.loads(self.tok.to_str())["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in known["merges"]]
        made = {a + b for a, b in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token")
        units = sorted(t for t in known["vocab"] if t not in made)
        self.rank = {t: i for i, t in enumerate([*units, *(a + b for a, b in merges)])}
        self.parts = {a + b: (a, b) for a, b in merges}
        self.entries = ahocorasick.Automaton()
        for t in self.rank:
            self.entries.add_word(t, t)
        self.entries.make_automaton()
        self.special = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.shown = {b: self.split(chr(b))[0][0] for b in range(128)} | dict(self._high_bytes())
        self.lead = frozenset(self.shown[b] for b in range(0x80, 0xC0))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: dict[str, tuple] = {"": ("", 0, b"", 0)}
        self.memo: dict[str, tuple[int, bytes]] = {}

    def _high_bytes(self) -> Iterator[tuple[int, str]]:
        """The letters that the pre-tokenizer shows for the bytes from 0x80."""
        for ch in (*map(chr, range(0x80, 0x800)), *map(chr, range(0x800, 0xD800, 64)), "\U00010000", "\U00040000", "\U00080000", "\U000c0000", "\U00100000"):
            yield from zip(ch.encode(), self.split(ch)[0][0], strict=True)

    def count(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def _keeps(self, a: str, b: str) -> bool:
        """Whether the encoder leaves the tokens ``a`` and ``b`` side by side, undoing their merges from the latest."""
        if not a:
            return True
        rank, parts = self.rank, self.parts
        limit, left, right = len(rank), a, b
        while True:
            joined = left + right
            if parts.get(joined) == (left, right) and rank[joined] < limit:
                return False
            i, j = rank[left], rank[right]
            if (i > j and left in parts) or right not in parts:
                if left not in parts:
                    return True
                limit, left = i, parts[left][1]
            else:
                limit, right = j + 1, parts[right][0]

    def _prefixes(self, shown: str) -> tuple[int, bytes]:
        """Token count of a pre-token and, for each of its characters, the change in the prefix count.

        The automaton lists the vocabulary entries that end at each place, longest first.  Prefixes of
        usual length are states that pre-tokens share: last token, count, changes, count at the last whole character.
        """
        n, lead, pairs, states = len(shown), self.lead, self.pairs, self.states
        if len(states) > MEMO:
            states.clear()
            states[""] = ("", 0, b"", 0)
        if len(pairs) > MEMO:
            pairs.clear()
        k = 0
        if n <= 64:
            k = n
            while shown[:k] not in states:
                k -= 1
        row: list[tuple | None] = [None] * (n + 1)
        row[k] = states[shown[:k]]
        for at, t in self.entries.iter(shown):
            if at < k or row[at + 1] is not None:
                continue
            i, start = at + 1, at + 1 - len(t)
            before = row[start] or states[shown[:start]]
            ok = pairs.get((before[0], t))
            if ok is None:
                ok = pairs[before[0], t] = self._keeps(before[0], t)
            if ok:
                count = before[1] + 1
                if n > 64:
                    row[i] = (t, count)
                    continue
                _, _, changes, whole = row[at]
                if i == n or shown[i] not in lead:
                    changes, whole = changes + (count - whole).to_bytes(2, "little", signed=True), count
                row[i] = states[shown[:i]] = (t, count, changes, whole)
        if None in row[k:]:
            raise ValueError(f"no last token for a prefix of {shown[:40]!r}")
        if n <= 64:
            return row[n][1], row[n][2]
        ends = [row[i][1] for i in range(1, n + 1) if i == n or shown[i] not in lead]
        return ends[-1], _changes(ends)

    def pretoken(self, piece: str) -> tuple[int, bytes]:
        """Tokens of a pre-token and the changes of its prefix counts."""
        got = self.memo.get(piece)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            if piece in CONTRACTIONS:
                ends = [self.count(piece[: i + 1]) for i in range(len(piece))]
                got = ends[-1], _changes(ends)
            else:
                got = self._prefixes("".join(map(self.shown.__getitem__, piece.encode())))
            self.memo[piece] = got
        return got

    def _plain(self, text: str) -> tuple[np.ndarray, int, list]:
        parts: list[bytes] = []
        fixes: list[tuple[int, int]] = []
        total, memo, at, before = 0, self.memo, 0, ""
        pieces = PIECE.findall(text) if USUAL(text) else [text[a:b] for _, (a, b) in self.split(text)]
        for piece in pieces:
            n, change = memo.get(piece) or self.pretoken(piece)
            # a run of white space ends one character early before a word, but a prefix that ends with the run holds it whole
            if before and piece[0].isspace() and before[-1].isspace():
                run = self.pretoken(before + piece[0])[0]
                fixes.append((at, run - self.pretoken(before)[0] - int.from_bytes(change[:2], "little", signed=True)))
            parts.append(change)
            total += n
            at += len(piece)
            before = piece
        changes = np.frombuffer(b"".join(parts), "<i2")
        if fixes:
            changes = changes.copy()
            for at, by in fixes:
                if at + 1 < len(changes):
                    changes[at] += by
                    changes[at + 1] -= by
        return changes, total, pieces

    def changes(self, text: str) -> bytes:
        """Differences (int16, little-endian) of the token counts of all prefixes of ``text``, by code point."""
        out, rest = [], text
        while rest:
            at, special = min(((rest.find(s), s) for s in self.special if s in rest), default=(len(rest), ""))
            plain, n, pieces = self._plain(rest[:at])
            out.append(plain.tobytes())
            if special:
                tail = at - sum(map(len, pieces[-2:]))
                base = n - self.count(rest[tail:at])
                ends = [n, *(base + self.count(rest[tail:at] + special[:k]) for k in range(1, len(special))), n + 1]
                out.append(np.diff(np.array(ends)).astype("<i2").tobytes())
            rest = rest[at + len(special) :]
        return b"".join(out)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` and ``prefix_changes`` (see ``PrefixCounter.changes``) of every whole text.

    ``tokenizer`` is the path of a byte-level BPE file, readable on every executor.  A null text counts
    as empty: no bytes, no changes.  Repeated keys stay separate rows; an empty table gives no rows.
    """

    def start():
        c = counter(tokenizer)

        def each(b: dict[str, list]) -> dict[str, list]:
            texts = [x or "" for x in b[text]]
            return {key: b[key], "n_bytes": [len(x.encode()) for x in texts], "prefix_changes": [c.changes(x) for x in texts]}

        return each

    return map_batches(docs, [key, text], f"`{key}` {field_ddl(docs, key)}, n_bytes bigint, prefix_changes binary", start)


@F.pandas_udf(T.LongType())
def _total(changes: pd.Series) -> pd.Series:
    return changes.map(lambda x: int(np.frombuffer(x, "<i2").sum(dtype=np.int64)))


def n_tokens(changes: str | Column = "prefix_changes") -> Column:
    """Token count of the whole text."""
    return _total(changes)


def tokens_before(position: int, changes: str | Column = "prefix_changes") -> Column:
    """Token count of the first ``position`` code points."""

    @F.pandas_udf(T.LongType())
    def at(x: pd.Series) -> pd.Series:
        return x.map(lambda v: int(np.frombuffer(v, "<i2")[:position].sum(dtype=np.int64)))

    return at(changes)


def fits(budget: int, changes: str | Column = "prefix_changes") -> Column:
    """Code points of the longest prefix whose own encoding has at most ``budget`` tokens."""

    @F.pandas_udf(T.LongType())
    def cut(x: pd.Series) -> pd.Series:
        def one(v: bytes) -> int:
            ok = np.flatnonzero(np.cumsum(np.frombuffer(v, "<i2"), dtype=np.int64) <= budget)
            return int(ok[-1]) + 1 if len(ok) else 0

        return x.map(one)

    return cut(changes)
