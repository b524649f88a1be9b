"""Operator 2: lines that repeat an earlier line, exactly or nearly, by an exact set-similarity join.

A line is the set of its words.  Words are put into one global order, rare ones first, by
counts in a fixed number of hash cells over all lines, so that the order needs no join.
Lines with equal sets are one record.  Two records over the threshold share a word of
their prefixes: one of a short prefix of the smaller set and one of a longer prefix of the
larger.  A word whose cell was hit once is in one record only and pairs nothing.  Length
and position filters, applied in part by the key (a prefix word goes to the size classes
that its place still allows), and parity bits, more of them for long lines, filter the pairs
that share a word, and pairs that pass are verified on their whole sets.

Only whether an earlier match exists is asked for.  So lines are first held against a few
of the earliest of their crowded buckets, a number of pairs that is linear in the lines and
settles large groups of near copies; then only pairs whose later line is still open are
formed.  Everything here is DataFrame functions.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, WS_CHARS, Tables, sized_broadcast

#: Hash cells of the word counts, cells of a block while they are put in order, and the bits that a word keeps beside its level.
CELLS, BLOCK = 1 << 21, 1 << 11
KEPT = (1 << 56) - 1
#: Levels of rarity for each doubling of a cell's count; level 0 is a count of one.
STEPS = 4
#: Words of a set up to which 64 parity bits are kept, and the columns of the bits.
FEW_WORDS, ODD = 96, ["odd0", "odd1", "odd2", "odd3"]
#: Logarithm (base 2) of a cell's count from which the buckets of its words are crowded, and records of such a bucket that others are held against.
CROWD, SPREAD = 7, 8
#: Ratio of neighbouring size classes.
CLASS_RATIO = 1.25
#: Parts of the buckets that are paired one after the other, so that the disk holds the entries of one part only.
PARTS = 2
#: Rows with the lines of a text that are sent to every task; the driver holds them several times over meanwhile.
FEW_SENT = FEW_ROWS // 8


def exploded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line for every line of every text; a null text has one empty line."""
    return docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def _split(text: Column) -> Column:
    """The words of a text and empty ones between them; plain spaces are parted in half the time of a pattern."""
    return F.split(functools.reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), WS_CHARS.replace(" ", ""), text), " ")


def word_levels(docs: DataFrame, text: str) -> DataFrame:
    """One row with ``levels``: for each cell the logarithm of how many words of all texts fall into it (none: 0), a byte each, as the driver holds them."""
    words = docs.select(F.explode(_split(F.coalesce(F.col(text), F.lit("")))).alias("w")).where("w <> ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(CELLS - 1).alias("cell")).agg(F.count("*").alias("n"))
    level = F.least(F.floor(F.log2(F.coalesce(F.col("n"), F.lit(1)).cast("double")) * STEPS), F.lit(127)).cast("tinyint")
    cells = docs.sparkSession.range(CELLS).withColumnRenamed("id", "cell").join(counts, "cell", "left").select((F.col("cell") % BLOCK).cast("int").alias("at"), F.expr(f"cell div {BLOCK}").cast("int").alias("block"), level.alias("level"))
    in_order = lambda at, what: F.transform(F.sort_array(F.collect_list(F.struct(at, what))), lambda x: x[what])
    blocks = cells.groupBy("block").agg(in_order("at", "level").alias("levels"))
    return blocks.agg(F.flatten(in_order("block", "levels")).alias("levels"))


def word_sets(lines: DataFrame, levels: DataFrame) -> DataFrame:
    """key, line_no and ``words``, the set in the global order, of the lines that have words."""
    bare = lines.select("key", "line_no", F.trim("line", F.lit(WS_CHARS)).alias("bare")).where("bare <> ''")
    # the levels are a scalar that the lambda takes by reference: as a joined column they would be copied for every line
    given = F.array(F.struct(F.array_distinct(F.transform(F.array_remove(_split(F.col("bare")), ""), lambda w: F.xxhash64(w))).alias("h"), levels.scalar().alias("levels")))
    # never null, so that they are sorted as plain numbers
    level = lambda g, h: F.call_function("shiftleft", F.coalesce(g["levels"][h.bitwiseAND(CELLS - 1).cast("int")], F.lit(0).cast("tinyint")).cast("bigint"), F.lit(56))
    placed = F.transform("given", lambda g: F.transform(g["h"], lambda h: level(g, h).bitwiseOR(h.bitwiseAND(KEPT))))
    placed = bare.select("key", "line_no", given.alias("given")).select("key", "line_no", F.get(placed, F.lit(0)).alias("placed"))
    return placed.select("key", "line_no", F.sort_array("placed").alias("words"))


def _parity(words: Column, n: Column) -> list[Column]:
    """Parity bits of a set, by the low bits of each word's hash: two sets differ in as many words as bits at least.

    Sets of up to ``FEW_WORDS`` have 64, larger ones 256 in four numbers, as 64 are all but random beyond.
    The four numbers' exclusive or is the one of 64 bits.
    """
    none = F.lit(0).cast("bigint")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(63).cast("int"))
    of = lambda k: F.aggregate(F.filter(words, lambda x: x.bitwiseAND(192) == 64 * k), none, lambda s, x: s.bitwiseXOR(bit(x)))
    whole = F.aggregate(words, none, lambda s, x: s.bitwiseXOR(bit(x)))
    return [F.when(n > FEW_WORDS, of(k)).otherwise(whole if k == 0 else none).alias(f"odd{k}") for k in range(4)]


def first_records(sets: DataFrame, num: int, den: int) -> DataFrame:
    """A row for each distinct set: key and line_no of its first line, n, ``prefix`` (none if no other set can be near) and parity."""
    length = F.when(F.col("n") * den >= num * (F.col("n") + 1), F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("int") + 1).otherwise(0)
    made = sets.select("key", "line_no", "words", F.size("words").alias("n"), F.xxhash64("words").alias("id1"), F.xxhash64(F.lit(7), "words").alias("id2"))
    made = made.select("key", "line_no", "id1", "id2", "n", F.slice("words", F.lit(1), length).alias("prefix"), *_parity(F.col("words"), F.col("n")))
    grouped = made.groupBy("id1", "id2").agg(F.min(F.struct("key", "line_no")).alias("at"), F.first(F.struct("n", "prefix", *ODD)).alias("own"))
    return grouped.select("at.*", "own.*")


def _entries(records: DataFrame) -> DataFrame:
    """A row for each prefix word that another record may hold."""
    rest = [c for c in records.columns if c != "prefix"]
    return records.select(*rest, F.posexplode("prefix").alias("pos", "token")).where(F.col("token") > KEPT)


def _candidate(num: int, den: int) -> Column:
    """Length, position and parity filters of a pair of entries."""
    n = F.col("an") + F.col("bn")
    size = F.least("an", "bn") * den >= num * F.greatest("an", "bn")
    # at most this many words are in one of the sets only; the rest after the shared word bounds the overlap
    apart = (den - num) * n
    place = (n - 2 * F.least(F.col("an") - F.col("apos"), F.col("bn") - F.col("bpos"))) * (den + num) <= apart
    odd = [F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}")) for c in ODD]
    differ = F.when(F.least("an", "bn") > FEW_WORDS, functools.reduce(operator.add, map(F.bit_count, odd))).otherwise(F.bit_count(functools.reduce(Column.bitwiseXOR, odd)))
    return size & place & (differ * (den + num) <= apart)


def _as(df: DataFrame, side: str, on: str = "token") -> DataFrame:
    return df.select(on, *(F.col(c).alias(side + c) for c in df.columns if c != on))


def _before(a: str, b: str) -> Column:
    """The line of side ``a`` comes before that of ``b``; a null key comes first."""
    return F.struct(f"{a}key", f"{a}line_no") < F.struct(f"{b}key", f"{b}line_no")


def _pair(later: str, earlier: str) -> list[Column]:
    return [F.col(f"{later}key").alias("lkey"), F.col(f"{later}line_no").alias("lline"), F.col(f"{earlier}key").alias("ekey"), F.col(f"{earlier}line_no").alias("eline")]


def crowd_pairs(records: DataFrame, num: int, den: int) -> DataFrame:
    """Each record with the first ``SPREAD`` records, told apart by a hash, of its crowded buckets.

    The words that a large group of near copies shares are crowded; most copies are settled here, by a number
    of pairs that is linear in the records.
    """
    rows = _entries(records).where(F.col("token") >= CROWD * STEPS << 56).withColumn("bucket", F.xxhash64("token", _size_class(F.col("n")))).drop("token")
    share = F.pmod(F.xxhash64("key", "line_no"), F.lit(SPREAD)).alias("share")
    hubs = rows.groupBy("bucket", share).agg(F.min(F.struct("key", "line_no", "n", "pos", *ODD)).alias("hub")).select("bucket", "hub.*")
    return _as(rows, "a", "bucket").join(_as(hubs, "b", "bucket"), "bucket").where(_before("b", "a") & _candidate(num, den)).select(*_pair("a", "b")).distinct()


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(CLASS_RATIO)).cast("int")


def open_pairs(records: DataFrame, num: int, den: int, part: int) -> DataFrame:
    """All pairs of records that meet in a bucket of a part, pass the filters and whose later record is not ``gone``.

    The smaller set (ties by line) sends each word of its short prefix to the size classes that the word's
    place allows, the larger one each word of its prefix to its own class.  Two gone records never meet: all
    smaller ones meet the open larger ones, and the open smaller ones the gone larger ones, which are few.
    """
    rows = _entries(records).where(F.pmod("token", F.lit(PARTS)) == part)
    n, pos = F.col("n"), F.col("pos")
    most = F.floor((n * den - pos * (den + num)) / F.lit(num))
    short = rows.where(pos * (den + num) <= n * (den - num)).withColumn("class", F.explode(F.sequence(_size_class(n), _size_class(F.greatest(most, n)))))
    # one number names word and class (should two share it, the filters and the check on whole sets part them), one the place: size, position, gone
    place = F.call_function("shiftleft", n.cast("bigint"), F.lit(32)).bitwiseOR(F.call_function("shiftleft", pos.cast("bigint"), F.lit(1))).bitwiseOR(F.col("gone").cast("bigint"))
    keyed = lambda df, s: df.select(F.xxhash64("token", "class").alias("bucket"), *(c for c in df.columns if c != "token")).select("bucket", F.col("key").alias(f"{s}key"), F.col("line_no").alias(f"{s}line_no"), place.alias(f"{s}place"), *(F.col(c).alias(s + c) for c in ODD))
    large = rows.withColumn("class", _size_class(n))
    # hashed, not sorted: a row is looked at once
    first = keyed(short, "a").join(keyed(large.where("not gone"), "b").hint("shuffle_hash"), "bucket")
    # a broadcast here spares a second shuffle of all open smaller ones
    second = keyed(short.where("not gone"), "a").join(sized_broadcast(keyed(large.where("gone"), "b"), FEW_ROWS // 2), "bucket")
    ordered = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & _before("a", "b"))
    b_later = _before("a", "b")
    wanted = F.when(b_later, ~F.col("bgone")).otherwise(~F.col("agone"))

    def passed(met: DataFrame) -> DataFrame:
        for s in "ab":
            of = F.col(f"{s}place")
            met = met.withColumns({f"{s}n": F.call_function("shiftright", of, F.lit(32)), f"{s}pos": F.call_function("shiftright", of, F.lit(1)).bitwiseAND((1 << 31) - 1), f"{s}gone": of.bitwiseAND(1) == 1})
        met = met.where(_candidate(num, den) & ordered & wanted)
        return met.select(*(F.when(b_later, x).otherwise(y).alias(name) for x, y, name in zip(_pair("b", "a"), _pair("a", "b"), ("lkey", "lline", "ekey", "eline"), strict=True)))

    return passed(first).union(passed(second)).distinct()


def _same(s: str) -> Column:
    return F.col(f"{s}key").eqNullSafe(F.col(f"_{s}key")) & (F.col(f"{s}line") == F.col(f"_{s}line"))


def _matched(pairs: DataFrame, docs: DataFrame, levels: DataFrame, key: str, text: str, num: int, den: int, tables: Tables) -> DataFrame:
    """at_key, at_line of the later lines of the pairs whose whole sets are near; sets are made again, once, for these lines only."""
    at = pairs.select(F.col("lkey").alias("at_key"), F.col("lline").alias("line_no")).union(pairs.select("ekey", "eline"))
    wanted = at.groupBy("at_key").agg(F.collect_set("line_no").alias("wanted"))  # lines of one text
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(sized_broadcast(wanted, FEW_SENT), F.col("key").eqNullSafe(F.col("at_key")))
    some = some.select("key", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), "wanted").select("key", "lines", F.explode("wanted").alias("line_no")).select("key", "line_no", F.get("lines", F.col("line_no")).alias("line"))
    sets = tables.write(f"sets{len(tables.paths)}", word_sets(some, levels))
    named = lambda s: sets.select(F.col("key").alias(f"_{s}key"), F.col("line_no").alias(f"_{s}line"), F.col("words").alias(f"{s}w"))
    both = pairs.join(named("l"), _same("l")).join(named("e"), _same("e"))
    shared = F.size(F.array_intersect("lw", "ew"))
    near = den * shared >= num * (F.size("lw") + F.size("ew") - shared)
    return both.where(near).select(F.col("lkey").alias("at_key"), F.col("lline").alias("at_line")).distinct()


def _at() -> Column:
    """The line of key, line_no is that of at_key, at_line; a null key is one like any other."""
    return F.col("key").eqNullSafe(F.col("at_key")) & (F.col("line_no") == F.col("at_line"))


def _rows(docs: DataFrame, key: str, text: str, tables: Tables) -> DataFrame:
    """__tm_row, the key and the text of every row; __tm_row names one row and orders as the key does.

    It is the key itself if no two rows share one.  Else it is the key, a print of the text and a serial
    number, and the rows are written once, as the number may differ from one reading to the next.
    """
    slim = docs.select(F.col(key), F.col(text), F.col(key).alias("__tm_row"))
    if slim.groupBy("__tm_row").count().where("count > 1").isEmpty():
        return slim
    name = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.monotonically_increasing_id().alias("serial"))
    return tables.write("rows", slim.withColumn("__tm_row", name))


def _repeats(docs: DataFrame, num: int, den: int, key: str, text: str, tables: Tables) -> DataFrame:
    """key and line_no of the lines to go, where ``key`` names one row."""
    levels = tables.write("levels", word_levels(docs, text))
    one = tables.write("one", first_records(word_sets(exploded(docs, key, text), levels), num, den))
    marked = one.withColumn("gone", F.lit(False))
    crowded = tables.write("crowded", crowd_pairs(one, num, den))
    gone = None
    if not crowded.isEmpty():
        gone = tables.write("gone", _matched(crowded, docs, levels, key, text, num, den, tables))
        marked = one.join(sized_broadcast(gone), _at(), "left").withColumn("gone", F.col("at_line").isNotNull()).drop("at_key", "at_line")
    met = [tables.write(f"met{k}", open_pairs(marked, num, den, k)) for k in range(PARTS)]
    pairs = functools.reduce(DataFrame.union, met)
    more = tables.write("more", _matched(pairs, docs, levels, key, text, num, den, tables))
    # every line of a record goes but its first, and that one too if the record matches an earlier one
    firsts = one.select("key", "line_no").join(sized_broadcast(gone.unionByName(more) if gone else more), _at(), "left_anti")
    firsts = tables.write("firsts", firsts.select(F.col("key").alias("at_key"), F.col("line_no").alias("at_line")))
    tables.drop(*(name for name in tables.paths if name not in ("rows", "firsts")))
    worded = exploded(docs, key, text).where(F.trim("line", F.lit(WS_CHARS)) != "").select("key", "line_no")
    return worded.join(firsts, _at(), "left_anti")


def repeated_lines(docs: DataFrame, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and line_no of every line that an earlier line matches with a Jaccard similarity of at least ``num / den``.

    Earlier is by key, then place in the text.  Words are case-sensitive.  Lines without words match nothing.
    An earlier line counts even if it is itself removed.  Null texts have no words; rows that repeat a key
    and text are separate, and all but one lose their lines; a null key comes before all others.  Rows of one
    key and unlike texts are ordered by a print of the text.
    """
    tables = Tables(docs.sparkSession)
    rows = _rows(docs, key, text, tables)
    gone = _repeats(rows, num, den, "__tm_row", text, tables)
    named = F.col("key.key") if "rows" in tables.paths else F.col("key")
    return gone.select(named.alias(key), "line_no")


def without_repeats(docs: DataFrame, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: key, n_lines, n_removed, ``removed`` (the numbers of its lines), and the text that is left."""
    tables = Tables(docs.sparkSession)
    rows = _rows(docs, key, text, tables)
    gone = _repeats(rows, num, den, "__tm_row", text, tables).groupBy(F.col("key").alias("__tm_key")).agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    lines = F.split(F.col(text), "\n")
    n_lines = F.coalesce(F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    gone = tables.write("removed", gone)
    # sent to every task only if all its lists together are short
    small = (gone.agg(F.sum(F.size("removed") + 8)).first()[0] or 0) <= 4 * FEW_ROWS
    gone = F.broadcast(gone) if small else gone
    out = rows.join(gone, F.col("__tm_row").eqNullSafe(F.col("__tm_key")), "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    left = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("removed"), s["i"]))
    # most texts lose nothing, and a null one has nothing to lose
    kept = F.when(F.size("removed") == 0, F.col(text)).when(F.col(text).isNotNull(), F.array_join(F.transform(left, lambda s: s["x"]), "\n"))
    return out.select(key, n_lines.cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed", kept.alias(text))
