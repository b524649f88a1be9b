"""Statistics of trades: counts, returns, drawdown, daily Sharpe, and the same by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.values import utc_day

METRICS = ["total_trades", "win_rate", "avg_gain", "avg_loss", "gross_pnl", "max_drawdown", "sharpe"]


def _flat(trades: DataFrame, keys: list[str]) -> DataFrame:
    """A-01, Q-23: zero returns count in the total but are neither gains nor losses."""
    r = F.col("pnl_pct")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"),
        zero(F.sum(F.when(r > 0, 1.0).otherwise(0.0)) / F.count("*")).alias("win_rate"),
        zero(F.avg(F.when(r > 0, r))).alias("avg_gain"),
        zero(F.avg(F.when(r < 0, r))).alias("avg_loss"),
        zero(F.sum(r)).alias("gross_pnl"),
    )


def drawdown(trades: DataFrame, keys: list[str]) -> DataFrame:
    """A-02: largest fall of equity that starts at 1 and compounds in entry order (``seq`` breaks ties).

    The fold is a running product and a running peak in one window pass, so a group's trades are sorted
    and streamed, not gathered.  Factors are multiplied one after the other: a sum of logarithms drifts from that
    in the last digits, and comes back from beyond the range of doubles where a product stays.
    """
    by = W.Window.partitionBy(*keys) if keys else W.Window.partitionBy(F.lit(0))
    order = by.orderBy("entry_time", "seq").rowsBetween(W.Window.unboundedPreceding, 0)
    run = trades.withColumn("equity", F.product(1 + F.col("pnl_pct")).over(order)).withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(order)))
    return run.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max((F.col("peak") - F.col("equity")) / F.col("peak"))).alias("max_drawdown"))


def sharpe(trades: DataFrame, keys: list[str]) -> DataFrame:
    """A-03: mean over deviation of daily sums by UTC day of exit; 0 for fewer than two days or no dispersion."""
    days = trades.groupBy(*keys, utc_day(F.col("exit_time")).alias("day")).agg(F.sum("pnl_pct").alias("r"))
    sd = F.stddev_samp("r")
    return days.groupBy(*keys).agg(F.when((F.count("*") >= 2) & (sd > 0), F.avg("r") / sd).otherwise(0.0).alias("sharpe"))


def trade_stats(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A-01..A-03 in one row for each group of ``keys``, or in one row."""
    keys = list(keys or [])
    if keys:
        return _flat(trades, keys).join(drawdown(trades, keys), keys).join(sharpe(trades, keys), keys)
    out = _flat(trades, []).crossJoin(drawdown(trades, [])).crossJoin(sharpe(trades, []))  # one row each
    return out.withColumn("max_drawdown", F.coalesce("max_drawdown", F.lit(0.0)))


def grouped_stats(trades: DataFrame, by: list[str]) -> DataFrame:
    """A-04: scope, key and the metrics: all trades, and those of each value of each column of ``by``; null keys go."""
    scopes = F.array(F.struct(F.lit("all").alias("scope"), F.lit("").alias("key")), *(F.struct(F.lit(c).alias("scope"), F.col(c).cast("string").alias("key")) for c in by))
    long = trades.withColumn("s", F.explode(scopes)).where(F.col("s.key").isNotNull()).withColumn("scope", F.col("s.scope")).withColumn("key", F.col("s.key")).drop("s")
    return trade_stats(long, ["scope", "key"])
