"""Operator 5: quality rules with thresholds learnt for each language and source.

Each metric of a document falls into an integer bucket of bounded relative error (exact
up to 63, then 32 buckets for each doubling).  A sketch is the count of each bucket; two
sketches merge by adding counts, so one grouped count builds the sketches of all
(language, source) groups and coarser ones are their sums.  A sketch is mixed with
``PRIOR`` documents' worth of its parent's, so a small group leans on its language and a
small language on all documents, by how few documents it has and without a switch.  A
tail quantile and the mean distance from the median, both read from the mixed sketch,
give the group's fence, and the documents are joined with the fences of their group.
Everything here is DataFrame functions: no text is shuffled, and no Python sees a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WS_CHARS, checkpoint, sized_broadcast, word_array

SYMBOLS = "#*$%&|<>"
#: Metric: whether only high values are bad, the tail quantile (per mille) from which a fence starts, and how many mean distances it lies beyond.
METRICS: dict[str, tuple[bool, int, int]] = {"symbols_per_mille": (True, 900, 4), "dup_lines_per_mille": (True, 980, 4), "repeats_per_mille": (True, 980, 8), "word_chars_per_hundred": (False, 900, 4)}
#: Documents' worth of its parent's sketch that a group's sketch is mixed with, and the weight of one document.
PRIOR, UNIT = 100, 1000
COUNTS = ["word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_words", "n_repeat_words"]


def _windows(words: Column) -> Column:
    """All three-word windows of a text; words hold no space, so a joined window names its words."""
    n = F.size(words)
    third = F.slice(words, F.lit(3), F.greatest(n - 2, F.lit(0)))
    second = F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0)))
    first = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))
    return F.zip_with(F.zip_with(first, second, lambda a, b: F.concat_ws(" ", a, b)), third, lambda ab, c: F.concat_ws(" ", ab, c))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words of every whole text.

    Null: all 0.  Lines without a word count in neither line number.
    """
    clean = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(clean, WS_CHARS, "")
    lines = F.filter(F.split(clean, "\n"), lambda x: F.trim(x, F.lit(WS_CHARS)) != "")
    a = docs.withColumn("_words", word_array(F.col(text))).withColumn("_lines", lines)
    a = a.withColumn("word_chars", F.length(bare).cast("long")).withColumn("n_symbols", (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"))
    a = a.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    a = a.withColumn("n_words", F.size("_words").cast("long")).withColumn("_windows", F.when(F.size("_words") >= 4, _windows(F.col("_words"))))
    # most texts repeat no window: only the others have theirs sorted, equal ones side by side, with their places
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(repeats, F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    a = a.withColumn("_sorted", placed).drop("_words", "_lines", "_windows")
    twin = lambda s, j, k: F.get(F.col("_sorted"), j + k)["w"].eqNullSafe(s["w"])
    again = F.filter("_sorted", lambda s, j: twin(s, j, -1) | twin(s, j, 1))
    a = a.withColumn("_places", F.sort_array(F.transform(again, lambda s: s["i"]))).drop("_sorted")
    # windows of three words at places p < q cover min(3, q - p) words up to q, and the last covers three
    covered = F.aggregate("_places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")))["n"]
    return a.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_metrics(counted: DataFrame) -> DataFrame:
    """Add the integer metrics that the rules judge (0 where nothing is there to judge)."""
    ratio = lambda a, times, b: F.when(F.col(b) > 0, F.expr(f"({times} * {a}) div {b}")).otherwise(F.lit(0)).cast("long")
    return (
        counted.withColumn("symbols_per_mille", ratio("n_symbols", 1000, "word_chars"))
        .withColumn("dup_lines_per_mille", ratio("n_dup_lines", 1000, "n_lines"))
        .withColumn("repeats_per_mille", ratio("n_repeat_words", 1000, "n_words"))
        .withColumn("word_chars_per_hundred", ratio("word_chars", 100, "n_words"))
    )


def bucket(v: Column) -> Column:
    """Sketch bucket of a non-negative integer: its five leading bits after the first, and their place."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(shift * 32 + F.call_function("shiftright", v, shift))


def bucket_low(b: Column) -> Column:
    """The least value of a bucket."""
    shift = F.floor((b - 32) / 32).cast("int")
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", (b - shift * 32).cast("long"), shift))


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of all metrics by group: keys, metric, bucket, n.  Merge two by adding n."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).cast("long").alias("bucket")) for m in METRICS))
    return measured.select(*keys, F.explode(pairs).alias("m")).groupBy(*keys, "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def mixed_with(own: DataFrame, parent: DataFrame, keys: list[str], parent_keys: list[str]) -> DataFrame:
    """keys, metric, bucket, w: each group's weights and, in proportion, ``PRIOR`` documents of its parent's.

    A group takes as many rows from its parent as that has buckets, some two thousand for a metric at most.
    """
    total = F.sum("w").over(W.Window.partitionBy(*parent_keys, "metric"))
    share = F.floor(F.col("w").cast("double") / total.cast("double") * F.lit(float(PRIOR * UNIT))).cast("long")
    prior = parent.select(*(F.col(k).alias(f"p_{k}") for k in parent_keys), F.col("metric").alias("p_metric"), "bucket", share.alias("w"))
    same = F.col("metric") == F.col("p_metric")
    for k in parent_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    taken = own.select(*keys, "metric").distinct().join(prior, same).select(*keys, "metric", "bucket", "w")
    return own.unionByName(taken).groupBy(*keys, "metric", "bucket").agg(F.sum("w").alias("w"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each group with the low and high fence of each metric."""
    by = W.Window.partitionBy(*keys, "metric")
    level = lambda i: F.create_map(*(x for m, v in METRICS.items() for x in (F.lit(m), F.lit(v[i]))))[F.col("metric")]
    v = bucket_low(F.col("bucket"))
    running = sketch.withColumn("v", v).withColumn("upto", F.sum("w").over(by.orderBy("bucket"))).withColumn("total", F.sum("w").over(by))
    at = lambda q: F.min(F.when(F.col("upto") * 1000 >= q * F.col("total"), F.col("v"))).over(by)
    placed = running.withColumn("mid", at(F.lit(500))).withColumn("tail", at(level(1))).withColumn("head", at(1000 - level(1)))
    far = placed.groupBy(*keys, "metric").agg(F.max("total").alias("total"), F.max("tail").alias("tail"), F.max("head").alias("head"), F.sum(F.col("w") * F.abs(F.col("v") - F.col("mid"))).alias("far"))
    reach = F.expr("far div total") * level(2)
    rows = far.select(*keys, "metric", F.when(level(0), F.lit(-1)).otherwise(F.col("head") - reach).alias("low"), (F.col("tail") + reach).alias("high"))
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return rows.groupBy(*keys).agg(F.struct(*(F.struct(pick(m, "low").alias("low"), pick(m, "high").alias("high")).alias(m) for m in METRICS)).alias("fence"))


def group_fences(measured: DataFrame) -> DataFrame:
    """lang, source, fence of every (language, source) group of ``measured`` (lang, source and the metrics)."""
    fine = checkpoint(sketches(measured, ["lang", "source"])).withColumn("w", F.col("n") * UNIT).drop("n")
    sums = lambda keys: fine.groupBy(*keys, "metric", "bucket").agg(F.sum("w").alias("w"))
    langs = mixed_with(sums(["lang"]), sums([]), ["lang"], [])
    return fences(mixed_with(fine, langs, ["lang", "source"], ["lang"]), ["lang", "source"])


def judge(docs: DataFrame, language: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Judge every document: all columns but the text, the counts, metrics, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules and every metric lies within the fences of its
    (language, source) group.  The sketches are built from all documents that pass the base rules.  Null
    languages and sources are groups of their own; null texts fail the base rules; repeated rows are judged
    alike; an empty table gives no rows; an input column named as one of the results gives way to it.
    """
    results = [*COUNTS, *METRICS, "base_failed", "kept"]
    own = [c for c in docs.columns if c != text and c.lower() not in results]
    # the input's columns travel as one struct, so that none can clash with those made here
    packed = docs.select(F.struct(*own).alias("row"), F.col(language).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    measured = checkpoint(with_metrics(base_counts(packed, "text")).drop("text").withColumn("base_failed", base_failed()))
    found = group_fences(measured.where(~F.col("base_failed"))).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "fence")
    # one row for each group; they go to every task only when few
    joined = measured.join(sized_broadcast(checkpoint(found), 100_000), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    within = F.lit(True)
    for m in METRICS:
        within = within & (F.col(m) >= F.col("fence")[m]["low"]) & (F.col(m) <= F.col("fence")[m]["high"])
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(True))
    return joined.withColumn("kept", kept).select(*(F.col("row")[c].alias(c) for c in own), *results)
