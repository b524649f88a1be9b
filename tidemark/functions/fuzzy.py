"""Approximate search of a quote in a longer text.

A quote is found if some run of words of the text, three quarters to eight fifths as long (and six more), has
a matching-block ratio of 0.82 with it.  Two bounds keep that ratio, which is dear, from most runs:

- A run of that ratio differs from the quote by few single-character edits, so the quote's least edit distance
  to anything that ends there is small.  One bit-parallel pass gives that distance for every end of the text.
- Matching blocks are a common subsequence, so the longest one bounds their length.

One run is enough, so the likeliest are asked first: those that lie as most shared words say.  Only without
one among them is the whole text passed.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from itertools import repeat

#: The least ratio, the least words of a quote and a text, and how long runs may be.
RATIO, LEAST_WORDS, SHORTEST, LONGEST, SPARE = 0.82, 6, 0.75, 1.6, 6


def _places(pattern: str) -> dict[str, int]:
    """For each character the places where it stands in ``pattern``, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def end_distances(pattern: str, text: str) -> list[int]:
    """For each place of ``text`` the least edit distance of ``pattern`` to a stretch that ends there (Myers 1999)."""
    m, where = len(pattern), _places(pattern)
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = every, 0, m, []
    for eq in map(where.get, text, repeat(0)):
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & every, plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        up, down = up << 1 & every, down << 1 & every
        plus, minus = down | ~(diagonal | up) & every, up & diagonal
        out.append(score)
    return out


def common_length(where: dict[str, int], m: int, text: str) -> int:
    """Length of the longest common subsequence with the pattern of ``where``, by bits (Hyyro 2004)."""
    row = every = (1 << m) - 1
    for c in text:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & every
    return m - row.bit_count()


def likely_runs(quote: list[str], text: list[str], least: int, most: int) -> list[list[str]]:
    """At most three runs of ``text`` as long as the quote, at the shifts that most of its words share with those of the quote."""
    at = {w: i for i, w in enumerate(quote)}
    shifts = Counter(j - at[w] for j, w in enumerate(text) if w in at)
    runs = (text[max(s, 0) : s + len(quote)] for s, _ in shifts.most_common(3) if s + len(quote) > 0)
    return [run for run in runs if least <= len(run) <= most]


def fuzzy_found(quote: list[str], text: list[str]) -> bool:
    """Whether a run of words of ``text`` is alike enough to the words of ``quote``."""
    if len(quote) < LEAST_WORDS or len(text) < LEAST_WORDS:
        return False
    least, most = max(LEAST_WORDS, int(len(quote) * SHORTEST)), min(len(text), int(len(quote) * LONGEST) + SPARE)
    if least > most:
        return False
    pattern, whole = " ".join(quote), " ".join(text)
    if any(SequenceMatcher(None, pattern, " ".join(run)).ratio() >= RATIO for run in likely_runs(quote, text, least, most)):
        return True
    # a ratio r allows (1 - r) (|quote| + |run|) insertions and deletions, and so that many edits; a run is at most
    # (2 - r) / r times as long as the quote
    allowed = (1 - RATIO) * 2 / RATIO * len(pattern) + 1e-9
    ends, at = [], -1
    for w in text:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    distance, where = end_distances(pattern, whole), _places(pattern)
    for last in range(least - 1, len(text)):
        if distance[ends[last] - 1] > allowed:
            continue
        for size in range(least, min(most, last + 1) + 1):
            run = whole[starts[last - size + 1] : ends[last]]
            total = len(pattern) + len(run)
            if 2 * min(len(pattern), len(run)) >= RATIO * total and 2 * common_length(where, len(pattern), run) >= RATIO * total - 1e-9 and SequenceMatcher(None, pattern, run).ratio() >= RATIO:
                return True
    return False
