"""Ratio bars of two series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def ratio_bars(base: DataFrame, quote: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """J-01, W-02, B-20: bars of base close over quote close where both have one, by time (and by ``keys``).

    The quote's last bar wins on a repeated time (``seq`` tells the order).  Highs and lows are those of the
    body: a bar opens at the previous matched ratio, the first at its own.
    """
    order = "seq" if "seq" in quote.columns else "open_time"
    one = quote.groupBy(*keys, "open_time").agg(F.max_by("close", order).alias("quote_close"))
    matched = base.join(one, [*keys, "open_time"]).withColumn("close_ratio", F.col("close") / F.col("quote_close"))
    series = W.Window.partitionBy(*keys).orderBy("open_time") if keys else W.Window.orderBy("open_time")
    opened = matched.withColumn("open_ratio", F.coalesce(F.lag("close_ratio").over(series), "close_ratio"))
    return opened.select(
        *keys, "open_time", F.col("open_ratio").alias("open"), F.greatest("open_ratio", "close_ratio").alias("high"), F.least("open_ratio", "close_ratio").alias("low"),
        F.col("close_ratio").alias("close"), "volume", F.col("close").alias("base_close"), "quote_close",
    )
