"""Logs and books: signals, analyses and reviews, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.symbols import normalize_symbol
from ..functions.values import month_of, pnl


def signal_problem(signals: DataFrame) -> DataFrame:
    """K-01: the first rule that a new signal breaks, or null, with its normalised symbol and month."""
    zone = lambda c: F.coalesce(F.size(c) == 2, F.lit(False))
    problem = F.when(normalize_symbol(F.col("symbol")).isNull(), "symbol").when(~F.col("signal_type").rlike("^(long|short)_"), "signal_type").when(~zone("entry_zone"), "entry_zone").when(~zone("target_zone"), "target_zone").when(month_of(F.col("logged_at")).isNull(), "logged_at")
    return signals.withColumn("problem", problem).withColumn("symbol", normalize_symbol(F.col("symbol"))).withColumn("month", month_of(F.col("logged_at")))


def append_monthly(df: DataFrame, path: str) -> None:
    """K-01, K-02, K-03, H-17: append records as JSON lines, a folder for each month."""
    df.write.mode("append").partitionBy("month").json(path)


def listed(df: DataFrame, start: str | None = None, end: str | None = None, **equal: str) -> DataFrame:
    """P-01, P-02, O-05, Q-05: records of a time range (both ends included) and of given values, by their time as text."""
    at = F.try_to_timestamp("logged_at")
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    if start:
        df = df.where(at >= F.try_to_timestamp(F.lit(start)))
    if end:
        df = df.where(at <= F.try_to_timestamp(F.lit(end)))
    return df.orderBy("logged_at", "seq")


def first_in_latest_month(df: DataFrame, key: str) -> DataFrame:
    """P-06, Q-19: the signal of each id: of the newest month, the first line."""
    w = W.Window.partitionBy(key).orderBy(F.col("month").desc(), F.col("seq").asc())
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def last_written(df: DataFrame, key: str) -> DataFrame:
    """P-06, Q-19: the analysis of each id that was written last."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), "seq").alias("r")).select(key, "r.*")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """A-14: the review of each analysis with the latest time; of equal times the one read last."""
    order = F.struct("reviewed_at", "seq")
    return reviews.groupBy("analysis_id").agg(F.max_by(F.struct("reviewed_at", "realized_direction", "hit_trigger"), order).alias("review"))


def with_reviews(analyses: DataFrame, reviews: DataFrame) -> DataFrame:
    """J-07: analyses with their latest review, or null."""
    return analyses.join(latest_reviews(reviews), "analysis_id", "left")


def accepted_reviews(reviews: DataFrame, analyses: DataFrame) -> DataFrame:
    """K-03: reviews whose analysis exists."""
    return reviews.join(analyses.select("analysis_id"), "analysis_id", "left_semi")


def fold_positions(events: DataFrame) -> DataFrame:
    """B-10: positions from open and close events (portfolio, id, seq, kind, symbol, side, size, price); the first close counts."""
    opened = events.where("kind = 'open'").groupBy("portfolio", "id").agg(F.min_by(F.struct("symbol", "side", "size", F.col("price").alias("entry_price")), "seq").alias("o"))
    closed = events.where("kind = 'close'").groupBy("portfolio", "id").agg(F.min_by("price", "seq").alias("exit_price"))
    p = opened.select("portfolio", "id", "o.*").join(closed, ["portfolio", "id"], "left")
    done = F.col("exit_price").isNotNull()
    return p.withColumn("status", F.when(done, "closed").otherwise("open")).withColumn("realized_pnl", F.when(done, pnl(F.col("side"), F.col("size"), F.col("entry_price"), F.col("exit_price"))))


def portfolio_state(positions: DataFrame, marks: DataFrame, cash: float) -> DataFrame:
    """A-13, J-08, Q-18: a row for each portfolio; opening moves no cash, closing adds its profit, a missing mark counts 0."""
    j = positions.join(marks, "symbol", "left")
    open_ = F.col("status") == "open"
    live = F.when(open_, F.coalesce(pnl(F.col("side"), F.col("size"), F.col("entry_price"), F.col("mark")), F.lit(0.0))).otherwise(0.0)
    out = j.groupBy("portfolio").agg(F.coalesce(F.sum("realized_pnl"), F.lit(0.0)).alias("realized"), F.sum(live).alias("unrealized"), F.sum((~open_).cast("long")).alias("closed_count"), F.sum(open_.cast("long")).alias("open_count"))
    return out.withColumn("cash", F.lit(cash) + F.col("realized")).withColumn("equity", F.col("cash") + F.col("unrealized"))
