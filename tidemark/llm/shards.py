"""Operator 9: contiguous shards of near-equal byte size.

Every row gets its place in one global order.  The order is cut into range partitions,
each partition's total is prefix-summed, and a row's global offset is its partition's
offset plus its running sum inside the partition.  Shards are cut where the global
offset passes equal shares of the total, so no task ever sees more than a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import checkpoint, result_name


def with_offsets(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``row_no`` and ``start`` (exclusive prefix sum of ``size``) in the order of ``order``.

    ``df`` should be narrow: it is range-partitioned and checkpointed once, because range
    bounds come from a sample and must not be drawn twice.  Rows that tie in ``order`` are
    spread by a serial number, so one repeated key cannot fill a partition.
    """
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    keys = [*order, "_salt"]
    ranged = checkpoint(salted.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    # one row for each range partition, so this window and broadcast are bounded by the partition count
    bases = parts.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rbase"))
    inside = W.Window.partitionBy("_part").orderBy(*keys)
    local = ranged.withColumn("_run", F.sum(size).over(inside.rowsBetween(W.Window.unboundedPreceding, 0)) - F.col(size)).withColumn("_no", F.row_number().over(inside) - 1)
    return local.join(F.broadcast(bases), "_part").withColumn("start", F.col("_base") + F.col("_run")).withColumn("row_no", F.col("_rbase") + F.col("_no")).drop("_part", "_salt", "_base", "_rbase", "_run", "_no")


def byte_shards(docs: DataFrame, n_shards: int, order: list[str] | None = None, text: str = "text", overhead: int = 8) -> DataFrame:
    """Assign each row to one of ``n_shards`` contiguous shards of near-equal bytes.

    Returns ``order`` columns, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each
    shard, in ``order``).  A row belongs to the shard in which its middle byte falls.  Null and empty
    texts have the overhead as size; repeated rows and equal keys are separate rows with consecutive
    slots; an empty table gives no rows.  A single row larger than a share fills its shard alone.
    """
    order = order or ["doc_id"]
    clean = F.coalesce(F.col(text), F.lit(""))
    # order columns go by names of their own meanwhile; one called like a result comes out with an underscore behind it
    own = {f"_o{k}": c for k, c in enumerate(order)}
    slim = docs.select(*(F.col(c).alias(o) for o, c in own.items()), (F.octet_length(clean) + overhead).cast("long").alias("size"), F.crc32(clean.cast("binary")).alias("text_crc32"))
    placed = with_offsets(slim, [*own, "text_crc32"], "size")
    placed = placed.crossJoin(F.broadcast(placed.agg(F.sum("size").alias("_total"))))  # a single row
    shard = F.least(F.lit(n_shards - 1), F.expr(f"({n_shards} * (2 * start + size)) div (2 * _total)")).cast("int")
    cut = placed.withColumn("shard", shard)
    first = cut.groupBy("shard").agg(F.min("row_no").alias("_first"))  # at most n_shards rows
    names = [F.col(o).alias(result_name(c, "size", "text_crc32", "shard", "slot")) for o, c in own.items()]
    return cut.join(F.broadcast(first), "shard").select(*names, "size", "text_crc32", "shard", (F.col("row_no") - F.col("_first")).cast("long").alias("slot"))
