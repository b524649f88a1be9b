"""Operator 3: grouped prefix join of documents by the Jaccard similarity of their word shingles.

Every distinct shingle set is one record; its shingles are put into one global order,
the rare ones first.  Two sets over the threshold share a shingle of their prefixes.
Records with the same prefix and size are one group: buckets of a shared prefix shingle
pair groups, by length and position, and only pairs of groups that pass are expanded to
members.  A parity bitmap, an upper bound on the overlap, filters member pairs before
their whole sets are compared.

Only the classes that links make are asked for, so links are looked for twice: first
between each member and the most central group of its buckets, a number of pairs that
is linear in the prefixes, and then between all candidates that are not yet in one class.  A large group of near copies is thereby one class before pairs are
formed.  Buckets beyond a block's size are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, _pieces, field_ddl, free_name, map_batches, result_name, sized_broadcast
from .components import components

#: ASCII letters in lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Word hashes kept per worker, some 100 bytes each; only speed depends on it.
MEMO = 60_000
#: Rows of a bucket that are compared in one piece.
BLOCK = 1024
#: Shingles whose frequency class all tasks know; the others rank as rare.  Only speed depends on it.
KNOWN = 1 << 18
#: Shingles that a task counts at once when it looks for frequent ones.
WINDOW = 1 << 20


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text; with fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(_hashes.__getitem__, words)), np.uint64)
    span = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - span + 1, span, np.uint64)
        for k in range(span):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k])
    return np.unique(out)


def _fresh(x: np.ndarray) -> np.ndarray:
    """Where a sorted array has a value other than the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``x``, which is sorted in place, and how often each occurs."""
    x.sort()
    starts = np.flatnonzero(_fresh(x))
    return x[starts], np.diff(starts, append=len(x))


def frequent_shingles(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(shingle, n) of shingles that recur, counted over all documents by lossy counting.

    Each task counts windows of its shingles and drops those that occur once in a window, so a count
    falls short by one for each window at most, and memory by window, not by vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        held: list[np.ndarray] = []
        n = 0

        def merged():
            seen, times = _runs(np.concatenate(held)) if held else (keys[:0], counts[:0])
            again = times > 1
            every, n = np.concatenate([keys, seen[again]]), np.concatenate([counts, times[again]])
            by = np.argsort(every, kind="stable")
            every, n = every[by], n[by]
            starts = np.flatnonzero(_fresh(every))
            both, total = every[starts], np.add.reduceat(n, starts) if len(starts) else n
            while len(both) > WINDOW:
                many = total > np.median(total)
                both, total = both[many], total[many]
            return both, total

        for b in _pieces(batches):
            for x in b.column(0).to_pylist():
                held.append(shingle_set(x, width))
                n += len(held[-1])
                if n >= WINDOW:
                    keys, counts = merged()
                    held, n = [], 0
        keys, counts = merged()
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    return docs.select(text).mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def frequency_classes(docs: DataFrame, text: str, width: int, tables: Tables, most: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the class (binary logarithm of the count) of each; at most ``most``."""
    level = F.length(F.bin("n"))
    counted = tables.write("counted", frequent_shingles(docs, text, width).withColumn("level", level))
    sizes = sorted(((r["level"], r["count"]) for r in counted.groupBy("level").count().collect()), reverse=True)  # 64 rows at most
    least, total = 65, 0
    for at, n in sizes:
        if total + n > most:
            break
        least, total = at, total + n
    got = counted.where(F.col("level") >= least).select("shingle", "level").toPandas()
    keys = got["shingle"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(keys)
    tables.drop("counted")
    return keys[by], got["level"].to_numpy(np.uint64)[by]


def in_order(shingles: np.ndarray, known: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The shingles in the global order: by frequency class, then by hash."""
    level = np.zeros(len(shingles), np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        level = np.where(known[at] == shingles, classes[at], 0).astype(np.uint64)
    return np.sort((level << np.uint64(57)) | (shingles >> np.uint64(7)))


def parity(shingles: np.ndarray) -> bytes:
    """Parity bitmap of a set: as many bits as the power of two from twice its size on, 64 at least."""
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def narrow(sig: bytes) -> list[int]:
    """The bitmap folded or repeated to 256 bits, as four signed numbers: with fewer bits the upper bound is only looser."""
    x = fold(sig, 32) if len(sig) >= 32 else int.from_bytes(sig, "little")
    return [int.from_bytes((x >> (64 * k) & (1 << 64) - 1).to_bytes(8), signed=True) for k in range(4)]


def fold(sig: bytes, size: int) -> int:
    """The bitmap that ``size`` bytes would hold, as a number."""
    x, n = int.from_bytes(sig, "little"), len(sig)
    while n > size:
        n //= 2
        x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
    return x


class Threshold:
    """Similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def alone(self, n: int) -> bool:
        """No other set can be near one of this size."""
        return n * self.den < self.num * (n + 1)

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def apart(self, total: int) -> int:
        """Most differing shingles of two near sets with ``total`` shingles."""
        return total * (self.den - self.num) // (self.den + self.num)

    def near(self, na: int, nb: int, pa: int, pb: int) -> bool:
        """Length and position filter; pa and pb are the places of the first shared shingle."""
        small, large = (na, nb) if na < nb else (nb, na)
        return small * self.den >= self.num * large and na + nb - 2 * min(na - pa, nb - pb) <= self.apart(na + nb)


def _records(docs: DataFrame, key: str, text: str, width: int, t: Threshold, known: np.ndarray, classes: np.ndarray) -> DataFrame:
    """One row a document: key, n, print (128 bits of its set), and for sets that may have partners prefix, groups and bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast((known, classes))

    def start():
        known, classes = sent.value

        def each(b: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {key: b[key], "n": [], "print": [], "prefix": [], "grp": [], "sig": [], "bits": []}
            for x in b[text]:
                s = shingle_set(x, width)
                n = len(s)
                out["n"].append(n)
                out["print"].append(blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                if n and not t.alone(n):
                    prefix = in_order(s, known, classes)[: t.prefix(n)].view(np.int64)
                    out["prefix"].append(prefix)
                    out["grp"].append(int.from_bytes(blake2b(prefix.tobytes() + n.to_bytes(8), digest_size=8).digest(), signed=True))
                    out["sig"].append(parity(s))
                    out["bits"].append(narrow(out["sig"][-1]))
                else:
                    for c in ("prefix", "grp", "sig", "bits"):
                        out[c].append(None)
            return out

        return each

    return map_batches(docs, [key, text], f"`{key}` {field_ddl(docs, key)}, n bigint, print binary, prefix array<bigint>, grp bigint, sig binary, bits array<bigint>", start)


def _near(t: Threshold, na: str, nb: str, pa: str, pb: str) -> Column:
    """``Threshold.near`` as a column."""
    n = F.col(na) + F.col(nb)
    size = F.least(na, nb) * t.den >= t.num * F.greatest(na, nb)
    return size & ((n - 2 * F.least(F.col(na) - F.col(pa), F.col(nb) - F.col(pb))) * (t.den + t.num) <= n * (t.den - t.num))


def _apart(t: Threshold) -> Column:
    """The narrow bitmaps of a and b allow the similarity; groups of several members have none and pass."""
    odd = sum((F.bit_count(F.get("abits", F.lit(k)).bitwiseXOR(F.get("bbits", F.lit(k)))) for k in range(4)), F.lit(0))
    n = F.col("an") + F.col("bn")
    # bitmaps of under 256 bits are compared only with their like: sizes that differ more are cut by the length filter or pass
    same = F.col("abits").isNull() | F.col("bbits").isNull() | (F.col("awide") != F.col("bwide"))
    return same | (odd * (t.den + t.num) <= n * (t.den - t.num))


def _groups(one: DataFrame) -> DataFrame:
    """A row for each group of records with one prefix and size: grp, n, prefix, members, and its only member's bitmap."""
    have = one.where(F.col("prefix").isNotNull())
    g = have.groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").alias("members"), F.first("bits").alias("bits"))
    return g.select("grp", F.col("n").cast("int").alias("n"), "prefix", "members", F.when(F.col("members") == 1, F.col("bits")).alias("bits"))


def _as(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[c for c in ("token", "i", "j") if c in df.columns], *(F.col(c).alias(side + c) for c in df.columns if c not in ("token", "i", "j")))


def _wide(n: Column) -> Column:
    """Full bitmaps from 256 bits on fold alike; smaller ones are of one width each."""
    return F.least(F.lit(256), F.call_function("shiftleft", F.lit(1), F.length(F.bin(2 * n.cast("bigint") - 1)).cast("int")))


def _hub_groups(hits: DataFrame, t: Threshold) -> DataFrame:
    """(agrp, bgrp): each group with the hub that it shares most prefix shingles with.

    The hub of a bucket is the group for which the shared shingle comes first in the order: it has the
    fewest shingles of its own.  The choice only sets which links are looked at first.
    """
    of = hits.groupBy("token").agg(F.min(F.struct("pos", "n", "grp")).alias("hub")).select("token", "hub.*")
    met = _as(hits, "a").join(_as(of, "b"), "token").where((F.col("agrp") != F.col("bgrp")) & _near(t, "an", "bn", "apos", "bpos"))
    best = met.groupBy("agrp", "bgrp").agg(F.count("*").alias("shared")).groupBy("agrp").agg(F.max(F.struct("shared", "bgrp")).alias("m"))
    return best.select("agrp", F.col("m.bgrp").alias("bgrp"))


def _group_pairs(hits: DataFrame, bits: DataFrame, label: DataFrame, t: Threshold, block: int) -> DataFrame:
    """All pairs of groups that pass the filters, from buckets with more than one class; a group of several classes has no label."""
    known = hits.join(bits.select("grp", "bits", "wide"), "grp").join(label, "grp", "left").withColumn("label", F.coalesce("label", "grp"))
    own = F.coalesce(F.col("mixed"), F.lit(False))
    mixed = known.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"), F.max(own).alias("any")).where("low <> high or any").select("token", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    rows = known.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("grp"), F.col("blocks")).cast("int"))
    # a bucket of several blocks is dealt out as all pairs of them, one with itself included
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("o", other).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o", "blocks")
    a, b = _as(rows.where("block = i"), "a"), _as(rows.where("block = j"), "b")
    differ = (F.col("alabel") != F.col("blabel")) | F.coalesce(F.col("amixed"), F.lit(False)) | F.coalesce(F.col("bmixed"), F.lit(False))
    once = (F.col("i") < F.col("j")) | (F.col("agrp") < F.col("bgrp"))
    met = a.join(b, ["token", "i", "j"]).where(once & differ & _near(t, "an", "bn", "apos", "bpos") & _apart(t))
    return met.select("agrp", "bgrp").distinct()


def _member_pairs(groups: DataFrame, one: DataFrame, label: DataFrame | None, t: Threshold, first_only: bool) -> DataFrame:
    """(a, b): members of the paired groups in different classes whose full bitmaps allow the similarity.

    With ``first_only`` each member of a meets one member of b, the hub, and one of its own group.
    """
    have = one.where(F.col("sig").isNotNull()).select("grp", "print", "n", "sig")
    have = have.join(label.select("print", "label"), "print", "left").withColumn("label", F.coalesce("label", "print")) if label is not None else have.withColumn("label", F.col("print"))
    lead = have.groupBy("grp").agg(F.min_by(F.struct("print", "n", "sig", "label"), "print").alias("x")).select("grp", "x.*")
    several = have.groupBy("grp").agg(F.count("*").alias("m")).where("m > 1").select(F.col("grp").alias("agrp"), F.col("grp").alias("bgrp"))
    pairs = groups.unionByName(several)
    met = pairs.join(_as(have, "a"), "agrp").join(_as(lead if first_only else have, "b"), "bgrp").where("alabel <> blabel")

    def start():
        def each(x: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"a": [], "b": []}
            for fa, fb, na, nb, sa, sb in zip(x["aprint"], x["bprint"], x["an"], x["bn"], x["asig"], x["bsig"], strict=True):
                size = min(len(sa), len(sb))
                if fa != fb and (fold(sa, size) ^ fold(sb, size)).bit_count() <= t.apart(na + nb):
                    out["a"].append(min(fa, fb))
                    out["b"].append(max(fa, fb))
            return out

        return each

    return map_batches(met, ["aprint", "bprint", "an", "bn", "asig", "bsig"], "a binary, b binary", start).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, roots: DataFrame, key: str, text: str, width: int, t: Threshold, tables: Tables, name: str) -> DataFrame:
    """The pairs whose whole sets are near; sets are made again, for the documents in question only."""
    wanted = pairs.select(F.col("a").alias("print")).union(pairs.select("b")).distinct()
    keys = sized_broadcast(tables.write(f"{name}_keys", roots.join(wanted, "print", "left_semi").select(F.col("root").alias("_root")).distinct()))
    some = docs.select(key, text).join(keys, F.col(key).eqNullSafe(F.col("_root")), "left_semi")

    def start():
        def each(b: dict[str, list]) -> dict[str, list]:
            sets = [shingle_set(x, width).tobytes() for x in b[text]]
            return {"print": [blake2b(s, digest_size=16).digest() for s in sets], "members": sets}

        return each

    sets = tables.write(name, map_batches(some, [text], "print binary, members binary", start).dropDuplicates(["print"]))
    tables.drop(f"{name}_keys")
    a, b = sets.select(F.col("print").alias("a"), F.col("members").alias("sa")), sets.select(F.col("print").alias("b"), F.col("members").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")

    def compare():
        def each(x: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"a": [], "b": []}
            for p, q, sa, sb in zip(x["a"], x["b"], x["sa"], x["sb"], strict=True):
                u, v = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                shared = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                if t.den * shared >= t.num * (len(u) + len(v) - shared):
                    out["a"].append(p)
                    out["b"].append(q)
            return out

        return each

    return map_batches(both, ["a", "b", "sa", "sb"], "a binary, b binary", compare)


def near_classes(docs: DataFrame, width: int = 3, num: int = 9, den: int = 10, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each document: key, ``n_shingles``, ``component_id`` (least key in its class, itself included).

    Documents link when their shingle sets have a Jaccard similarity of at least ``num / den``; classes are
    what links connect.  Null texts and texts without words have an empty set and link with nothing.
    Repeated rows and equal sets are one class; a null key is less than none, and stands for a class
    only if all its keys are null; an empty table gives no rows.  Sets are of 64-bit hashes.  A key called
    like a result column comes out with an underscore behind it.
    """
    out_key = result_name(key, "n_shingles", "component_id")
    docs, key, text = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_id", "_text"
    t = Threshold(num, den)
    tables = Tables(docs.sparkSession)
    known, classes = frequency_classes(docs, text, width, tables)
    records = tables.write("records", _records(docs, key, text, width, t, known, classes))
    own = F.first(F.struct("n", "prefix", "grp", "sig", "bits")).alias("own")
    one = tables.write("one", records.where(F.col("n") > 0).groupBy("print").agg(F.min(key).alias("root"), own).select("print", "root", "own.*"))
    roots = one.select("print", "root")
    groups = tables.write("groups", _groups(one).withColumn("wide", _wide(F.col("n"))))
    # slim entries: most prefix shingles are in one group only, and go before anything else is joined
    entries = groups.select(F.posexplode("prefix").alias("pos", "token"), "grp", "n")
    shared = entries.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    hits = tables.write("hits", entries.join(shared, "token").select("token", F.col("pos").cast("int").alias("pos"), "grp", "n"))
    likely = tables.write("likely", _member_pairs(_hub_groups(hits, t), one, None, t, first_only=True))
    first = tables.write("first", _verified(likely, docs, roots, key, text, width, t, tables, "sets1"))
    tables.drop("likely", "sets1")
    label = tables.write("label", components(first).withColumnRenamed("node", "print"))
    marked = one.where(F.col("grp").isNotNull()).join(label, "print", "left").withColumn("label", F.coalesce("label", "print"))
    by_group = tables.write("by_group", marked.groupBy("grp").agg(F.min(F.xxhash64("label")).alias("label"), (F.min("label") != F.max("label")).alias("mixed")))
    open_ = tables.write("open", _group_pairs(hits, groups, by_group, t, block))
    tables.drop("hits", "groups", "by_group")
    pairs = tables.write("pairs", _member_pairs(open_, one, label, t, first_only=False))
    more = tables.write("more", _verified(pairs, docs, roots, key, text, width, t, tables, "sets2"))
    tables.drop("open", "pairs", "sets2", "label")
    final = components(first.union(more)).withColumnRenamed("node", "print")
    labelled = tables.write("labelled", roots.join(final, "print", "left").withColumn("label", F.coalesce("label", "print")))
    least = labelled.groupBy("label").agg(F.min("root").alias("component_id"))
    by_print = tables.write("by_print", labelled.join(least, "label").select("print", "component_id"))
    tables.drop("one", "first", "more", "labelled")
    out = records.select(key, F.col("n").alias("n_shingles"), "print").join(by_print, "print", "left")
    return out.select(F.col(key).alias(out_key), "n_shingles", F.coalesce("component_id", key).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those of a class whose key isn't the least in it, with all their columns.

    Rows that repeat in key and text leave one; rows that share a key but not a text are all judged by that key.
    """
    name = free_name(docs, of="_key")
    classes = near_classes(docs.select(F.col(key).alias(name), text), width, num, den, name, text)
    gone = sized_broadcast(classes.where(~F.col(name).eqNullSafe(F.col("component_id"))).select(name).distinct())
    kept = docs.join(gone, F.col(key) == F.col(name), "left_anti")
    repeats = docs.groupBy(key).count().where("count > 1").limit(1).count()
    return kept.dropDuplicates([key, text]) if repeats else kept
