"""Operator 10: exact phrase and proximity matches of a test set in a training corpus.

The positional inverted index is partitioned by training document, as in distributed
search engines: a document's postings (term, ascending positions) stay together, and
terms that no test item has are left out.  The postings are stored in the shared folder;
corpus-wide frequencies and matches are both read from them, so texts are split once.
Test phrases are sent to the partitions in blocks of bounded size.  A phrase is searched
from its rarest term, by corpus-wide frequency: its positions, less its offset in the
phrase, are intersected with the offset-adjusted positions of the next rarest term, and
so on until none is left.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, _pieces, field_ddl, filter_batches, map_batches, result_name

#: Bytes of test text that are sent to the tasks at once; larger test sets are searched in blocks.
#: A byte of test text takes some 150 as phrases in Python, so a full block takes some 300 MB on the driver and in a worker.
BLOCK_BYTES = 2 << 20
#: ASCII letters in lower case, and every other ASCII byte but digits a separator.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Phrases:
    """The phrases of a block of test items, with the terms they are made of."""

    def __init__(self, items: list[tuple[object, str | None]], width: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.phrases: dict[tuple[int, ...], list[int]] = defaultdict(list)
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            row = [self.ids.setdefault(w, len(self.ids)) for w in terms(text)]
            for at in range(max(1, len(row) - width + 1) if row else 0):
                of = self.phrases[tuple(row[at : at + width])]
                if not of or of[-1] != k:
                    of.append(k)
        self.anchored: dict[int, list[tuple[tuple[tuple[int, int], ...], int, list[int]]]] = {}

    def rank(self, counts: dict[int, int]) -> None:
        """Order each phrase's places from the rarest term, and file the phrase under it."""
        filed = defaultdict(list)
        for phrase, of in self.phrases.items():
            places = sorted(enumerate(phrase), key=lambda p: (counts.get(p[1], 0), p[1], p[0]))
            if all(counts.get(t, 0) for t in phrase):  # a phrase with a term that no document has is nowhere
                filed[places[0][1]].append((tuple(places), len(phrase), of))
        self.anchored = dict(filed)


def _blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> list[DataFrame]:
    sized = items.select(key, text)
    total = sized.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))))).first()[0] or 0
    n = max(1, -(-total * 5 // (4 * block_bytes)))
    return [sized.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(n)) == k) for k in range(n)] if n > 1 else [sized]


def term_counts(docs: DataFrame, phrases: Phrases, text: str = "text") -> dict[int, int]:
    """Occurrences in all of ``docs`` of each term of a block; as many rows reach the driver as the block has terms."""
    ids = docs.sparkSession.sparkContext.broadcast(phrases.ids)

    def run(batches):
        known = ids.value
        total: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                total.update(filter(known.__contains__, terms(x)))
        yield pa.RecordBatch.from_pydict({"term": pa.array([known[t] for t in total], pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    found = docs.select(text).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in found.collect()}


def postings(docs: DataFrame, phrases: Phrases, keep: list[str], text: str = "text") -> DataFrame:
    """The index: for each document its ``keep`` columns, ``n_words``, and flat postings lists.

    ``term`` holds the document's test terms, ``until`` where each term's positions end in ``position``.
    """
    ids = docs.sparkSession.sparkContext.broadcast(phrases.ids)

    def start():
        known = ids.value

        def each(b: dict[str, list]) -> dict[str, list]:
            out = {c: b[c] for c in keep} | {"n_words": [], "term": [], "until": [], "position": []}
            for x in b[text]:
                words = terms(x)
                found: dict[int, list[int]] = {}
                for at, t in enumerate(map(known.get, words)):
                    if t is not None:
                        if t in found:
                            found[t].append(at)
                        else:
                            found[t] = [at]
                until, flat = [], []
                for p in found.values():
                    flat += p
                    until.append(len(flat))
                out["n_words"].append(len(words))
                out["term"].append(list(found))
                out["until"].append(until)
                out["position"].append(flat)
            return out

        return each

    kept = ", ".join(f"`{c}` {field_ddl(docs, c)}" for c in keep)
    return map_batches(docs, [*keep, text], f"{kept}, n_words bigint, term array<int>, until array<int>, position array<int>", start)


def stored_counts(index: DataFrame) -> dict[int, int]:
    """Occurrences of each term in stored postings; as many rows reach the driver as the block has terms."""
    each = F.expr("zip_with(term, zip_with(until, slice(concat(array(0), until), 1, size(until)), (z, a) -> z - a), (t, n) -> struct(t, n))")
    found = index.select(F.explode(each).alias("p")).groupBy("p.t").agg(F.sum("p.n").alias("n"))
    return {r["t"]: r["n"] for r in found.collect()}


def _lists(term: list[int], until: list[int], position: list[int]) -> dict[int, list[int]]:
    return {t: position[a:b] for t, a, b in zip(term, [0, *until], until, strict=False)}


def _starts(places: tuple[tuple[int, int], ...], lists: dict[int, list[int]]) -> set[int]:
    starts: set[int] = set()
    for k, (offset, t) in enumerate(places):
        here = lists.get(t)
        if here is None:
            return set()
        starts = {p - offset for p in here} if not k else starts.intersection([p - offset for p in here])
        if not starts:
            break
    return starts


def _close(places: tuple[tuple[int, int], ...], lists: dict[int, list[int]], span: int) -> list[tuple[int, int]]:
    """Shortest stretches of at most ``span`` words that hold all terms of a phrase, as often as the phrase does."""
    need = Counter(t for _, t in places)
    if any(len(lists.get(t, ())) < n for t, n in need.items()):
        return []
    marks = sorted((p, t) for t in need for p in lists[t])
    have: Counter = Counter()
    out, low, lacking = [], 0, sum(need.values())
    for p, t in marks:
        have[t] += 1
        lacking -= have[t] <= need[t]
        while have[marks[low][1]] > need[marks[low][1]]:
            have[marks[low][1]] -= 1
            low += 1
        if not lacking and p - marks[low][0] < span:
            out.append((marks[low][0], p + 1))
    return out


def _search(index: DataFrame, phrases: Phrases, keep: list[str], slop: int | None, earlier: bool) -> DataFrame:
    """Per document the items found (``item_ids``) and flat bounds of the matched stretches (``hits``), with those of earlier blocks.

    Postings become Python lists only for documents that have some phrase's rarest term; others can't have a phrase.
    """
    sent = index.sparkSession.sparkContext.broadcast((phrases.anchored, phrases.items, len(phrases.ids)))
    old = ["item_ids", "hits"] if earlier else []
    through = [*keep, "n_words"]

    def run(batches):
        anchored, names, n_terms = sent.value
        rare = np.zeros(n_terms, bool)
        rare[list(anchored)] = True

        def found(term: list[int], until: list[int], position: list[int]) -> tuple[set[int], set[tuple[int, int]]]:
            items: set[int] = set()
            hits: set[tuple[int, int]] = set()
            lists = _lists(term, until, position)
            for t in anchored.keys() & lists.keys():
                for places, length, of in anchored[t]:
                    got = [(s, s + length) for s in _starts(places, lists)] if slop is None else _close(places, lists, length + slop)
                    if got:
                        hits.update(got)
                        items.update(of)
            return items, hits

        for b in _pieces(batches):
            at = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            ids = at["item_ids"].to_pylist() if earlier else [[] for _ in range(b.num_rows)]
            bounds = at["hits"].to_pylist() if earlier else [[] for _ in range(b.num_rows)]
            ends = at["term"].offsets.to_numpy() - at["term"].offsets[0].as_py()
            upto = np.concatenate([[0], np.cumsum(rare[at["term"].flatten().to_numpy()])])
            rows = np.flatnonzero(upto[ends[1:]] > upto[ends[:-1]])
            for k, *lists in zip(rows.tolist(), *(at[c].take(pa.array(rows)).to_pylist() for c in ("term", "until", "position")), strict=True):
                items, hits = found(*lists)
                if items:
                    hits.update(zip(bounds[k][::2], bounds[k][1::2], strict=True))
                    ids[k] = sorted({names[i] for i in items}.union(ids[k]))
                    bounds[k] = _merged(hits)
            yield pa.RecordBatch.from_arrays([*(at[c] for c in through), pa.array(ids, pa.list_(pa.string())), pa.array(bounds, pa.list_(pa.int32()))], names=[*through, "item_ids", "hits"])

    kept = "".join(f"`{c}` {field_ddl(index, c)}, " for c in keep)
    return index.select(*through, "term", "until", "position", *old).mapInArrow(run, f"{kept}n_words bigint, item_ids array<string>, hits array<int>")


def _merged(hits: set[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, z in sorted(hits):
        if out and a <= out[-1]:
            out[-1] = max(z, out[-1])
        else:
            out += (a, z)
    return out


def matches(docs: DataFrame, items: DataFrame, width: int = 10, slop: int | None = None, carry: tuple[str, ...] = ("doc_id",), text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: its ``carry`` columns, n_words, item_ids (found, sorted as strings), hits.

    ``hits`` is the union of matched word ranges as flat [start, end, start, end, ...].  A phrase is ``width``
    consecutive words of an item, or all words of a shorter item; items without words have none.  With
    ``slop`` the words of a phrase match in any order within its length plus ``slop`` words; without, exactly.
    Null texts have no words and no hits; repeated rows each get their row; an empty corpus gives no rows, an
    empty test set no hits.  A null item key counts as an empty name.  A carried column called like a result
    comes out with an underscore behind it.
    """
    blocks = _blocks(items, item_key, item_text, block_bytes)
    tables = Tables(docs.sparkSession)
    own = {c: f"_c{k}" for k, c in enumerate(dict.fromkeys([*carry, text]))}
    out = docs.select(*(F.col(c).alias(o) for c, o in own.items()))
    names = {own[c]: result_name(c, "n_words", "item_ids", "hits") for c in carry}
    carry, text = tuple(own[c] for c in carry), own[text]
    for k, block in enumerate(blocks):
        phrases = Phrases([("" if r[0] is None else str(r[0]), r[1]) for r in block.collect()], width)  # bounded by block_bytes
        # texts go on to the next block's index, the last one drops them unless asked for
        keep = [*dict.fromkeys([*carry, *([text] if k + 1 < len(blocks) else [])])]
        through = [*keep, *(["item_ids", "hits"] if k else [])]
        index = tables.write(f"postings{k}", postings(out, phrases, through, text))
        if k:
            tables.drop(f"postings{k - 1}")
        phrases.rank(stored_counts(index))
        out = _search(index, phrases, keep, slop, earlier=k > 0)
    return out.select(*(F.col(c).alias(names.get(c, c)) for c in out.columns))


def clean(docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no phrase of the test items occurs, with all their columns."""
    spark, out = docs.sparkSession, docs
    for block in _blocks(items, item_key, item_text, block_bytes):
        phrases = Phrases([("" if r[0] is None else str(r[0]), r[1]) for r in block.collect()], width)  # bounded by block_bytes
        phrases.rank(term_counts(docs, phrases, text))
        sent = spark.sparkContext.broadcast((phrases.ids, phrases.anchored))

        def start(sent=sent):
            known, anchored = sent.value

            def free(x: str | None) -> bool:
                lists: dict[int, list[int]] = {}
                row = list(map(known.get, terms(x)))
                if anchored.keys().isdisjoint(row):
                    return True
                for at, t in enumerate(row):
                    if t is not None:
                        lists.setdefault(t, []).append(at)
                return not any(_starts(places, lists) for t in anchored.keys() & lists.keys() for places, _, _ in anchored[t])

            return lambda b: [free(x) for x in b[text]]

        out = filter_batches(out, [text], start)
    return out


def hit_words(hits: str = "hits") -> Column:
    """Number of words in the matched ranges."""
    return F.expr(f"aggregate({hits}, 0L, (n, x) -> x - n)")
