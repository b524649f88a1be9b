"""Operator 7: mixing sources to target weights along a low-discrepancy schedule.

Slot ``k`` of the mix has the golden-ratio point ``frac(k / phi)``.  The point is mapped
through the cumulative slot shares of the sources, the slots of each source are ranked,
and rank ``r`` takes the ``r``-th block of that source's shuffled token stream.  All
blocks hold ``block_tokens`` words but for the last one of each source, which is cut at
the target.  A stream is the source's documents in shuffled order, and once more from
the start where the target is above the source's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpoint, free_name, sized_broadcast, word_count

GOLDEN = 0.6180339887498949
#: Cells of the unit interval in which slots meet the sources' shares.
CELLS = 4096
#: Sources that are sent to every task; more are joined by shuffle.
FEW_SOURCES = 100_000
#: Slots that one ranking task holds.
RUN = 1 << 16


def _source_order(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """Sources with their weight: by code point, null last, weights repeating (one row for each source)."""
    place = F.row_number().over(W.Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    return sizes.withColumn("place", place).withColumn("weight", F.array(*map(F.lit, weights))[F.col("place") % len(weights)])


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Add ``target``: ``share`` of all sizes by weight, at most ``most`` times a source's size.

    What sources can't take is dealt again by weight until none is above its limit.  The level
    ``target / weight`` is one number for all sources below their limit; it only rises, so the loop
    keeps two sums on the driver and ends after at most as many rounds as there are sources.
    """
    ordered = checkpoint(_source_order(sizes, weights))
    level, total = -1.0, None
    limit = most * F.col("source_size")
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        row = ordered.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, limit).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        total = share * (row["all"] or 0)
        new = (total - row["held"]) / row["open"] if row["open"] else level
        if new <= level or not row["open"]:
            break
        level = new
    return ordered.withColumn("target", F.least(limit, F.lit(max(level, 0.0)) * F.col("weight")).cast("double"))


def schedule(sources: DataFrame, block_tokens: int) -> DataFrame:
    """Slots of the mix: ``slot`` (its turn), ``place`` (of the source), ``rank`` and ``epoch_words`` taken.

    ``sources`` has place, source_size and quota (whole words to take).  Source shares of the unit interval
    are proportional to their needed slots, so ranks come out evenly spread; the few ranks that the
    sequence has not reached after as many points as slots are needed follow at the end.
    """
    spark = sources.sparkSession
    need = F.ceil(F.col("quota") / block_tokens).cast("long")
    upto = W.Window.orderBy("place").rowsBetween(W.Window.unboundedPreceding, 0)
    shares = sources.withColumn("need", need).withColumn("upto", F.sum("need").over(upto))
    shares = checkpoint(shares.crossJoin(F.broadcast(shares.agg(F.sum("need").alias("slots")))).withColumn("low", (F.col("upto") - F.col("need")) / F.col("slots")).withColumn("high", F.col("upto") / F.col("slots")))
    n = (shares.agg(F.max("slots")).first()[0]) or 0
    cells = shares.where("need > 0").select("place", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.lit(CELLS - 1).cast("long"), F.floor(F.col("high") * CELLS)))).alias("cell"))
    turn = F.col("id") * F.lit(GOLDEN)
    points = spark.range(n).select(F.col("id").alias("slot"), (turn - F.floor(turn)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = points.join(cells, "cell").where("low <= u and u < high").select("slot", "place", F.floor(F.col("slot") / RUN).alias("run"))
    runs = dealt.groupBy("place", "run").agg(F.count("*").alias("n"))
    before = W.Window.partitionBy("place").orderBy("run").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = runs.select("place", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.Window.partitionBy("place", "run").orderBy("slot")
    ranked = dealt.withColumn("no", F.row_number().over(inside) - 1).join(bases, ["place", "run"]).select("slot", "place", (F.col("base") + F.col("no")).alias("rank"))
    met = runs.groupBy("place").agg(F.sum("n").alias("met"))
    left = shares.join(met, "place", "left").withColumn("met", F.coalesce("met", F.lit(0))).where("need > met")
    tail = left.select((F.lit(n) + F.col("place")).alias("slot"), "place", F.explode(F.sequence("met", F.col("need") - 1)).alias("rank"))
    both = ranked.unionByName(tail).join(sized_broadcast(shares.select("place", "need", "quota"), FEW_SOURCES), "place").where("rank < need")
    return both.select("slot", "place", "rank", F.least(F.lit(block_tokens).cast("long"), F.col("quota") - F.col("rank") * block_tokens).alias("words"))


def shuffled_stream(docs: DataFrame, n_runs: int = 1024) -> DataFrame:
    """Add ``at``, the place of a document's first word in its source's shuffled stream.

    The shuffle order is a hash of the id and the text.  Its leading part cuts every source, also the
    largest, into ``n_runs`` runs whose totals are prefix-summed.
    """
    mixed = docs.withColumn("run", F.pmod(F.shiftright("order", 20), F.lit(n_runs)))
    keys = ["place", "run"]
    totals = mixed.groupBy(*keys).agg(F.sum("size").alias("n"))
    before = W.Window.partitionBy("place").orderBy("run").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = totals.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.Window.partitionBy(*keys).orderBy("order", "key", "serial").rowsBetween(W.Window.unboundedPreceding, 0)
    return mixed.withColumn("upto", F.sum("size").over(inside)).join(bases, keys).withColumn("at", F.col("base") + F.col("upto") - F.col("size")).drop("run", "base", "upto", "order")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, block_tokens: int = 2048, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Deal the words of ``docs`` into a mix of ``share`` times all words, by source weight.

    Returns (uses, documents).  ``documents`` has a row for each input row: serial, key, place, source, size,
    source_size, target, at and taken, the words that the mix takes from it, repeats counted (at most twice
    its size).  ``uses`` has the mix itself: slot, serial, key, skip and words say which words of which document
    a slot holds, in turn by ``slot``.  Null and empty texts have size 0 and are never taken; a null
    source is a source of its own; repeated rows are separate documents; an empty table gives no rows.
    Reruns give the same rows: every order is a hash of the row or a computed number.
    """
    if most > 2:
        raise ValueError("a stream is dealt at most twice")
    slim = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit("mix"), F.col(key).cast("string"), F.col(text)).alias("order"))
    # rows that agree in all of this share one serial's fate only up to their order, which does not matter
    slim = checkpoint(slim.withColumn("serial", F.monotonically_increasing_id()))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, most)
    sources = checkpoint(sources.withColumn("quota", F.least(F.round("target").cast("long"), F.floor(most * F.col("source_size")))))
    # the sources, one row each, are sized before they are sent to all tasks; joins by shuffle beyond that
    few = sources.count() <= FEW_SOURCES
    dim = F.broadcast(sources.drop("weight")) if few else sources.drop("weight")
    placed = slim.join(dim.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    stream = checkpoint(shuffled_stream(placed))
    blocks = schedule(sources, block_tokens).select("slot", "place", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("epoch"), (F.col("rank") * block_tokens).alias("low"), (F.col("rank") * block_tokens + F.col("words")).alias("high"))
    blocks = blocks.join(F.broadcast(sources.select("place", "source_size")) if few else sources.select("place", "source_size"), "place")
    start = F.col("epoch") * F.col("source_size")
    blocks = blocks.withColumn("low", F.greatest("low", start) - start).withColumn("high", F.least("high", start + F.col("source_size")) - start).where("low < high")
    # blocks of the second epoch lie across block bounds of the first, so both meet in cells of a block's width
    b = blocks.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / block_tokens), F.floor((F.col("high") - 1) / block_tokens))))
    d = stream.where("size > 0").select("serial", "key", "place", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block_tokens), F.floor((F.col("at") + F.col("size") - 1) / block_tokens))).alias("cell"))
    low, high = F.greatest(F.col("at"), F.col("low"), F.col("cell") * block_tokens), F.least(F.col("at") + F.col("size"), F.col("high"), (F.col("cell") + 1) * block_tokens)
    uses = d.join(b.drop("source_size"), ["place", "cell"]).where(low < high).select("slot", "serial", "key", (low - F.col("at")).alias("skip"), (high - low).alias("words"))
    taken = uses.groupBy("serial").agg(F.sum("words").alias("taken"))
    out = stream.join(taken, "serial", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return uses, out


def mixed(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, block_tokens: int = 2048, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, with all their columns: each as often as the mix takes its words, rounded to whole times.

    Only the documents at the end of a source's stream are taken in part.  Rows of one key share the mean.
    """
    _, taken = mix(docs, weights, share, most, block_tokens, key, text, source)
    name, n, turn = (free_name(docs, of=x) for x in ("_key", "_times", "_turn"))
    times = taken.where("size > 0").groupBy(F.col("key").alias(name)).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(n))
    counted = sized_broadcast(times.where(F.col(n) > 0))
    return docs.join(counted, F.col(key).eqNullSafe(F.col(name))).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(name, n, turn)
