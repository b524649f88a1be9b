"""Scan rules over bars, cross-sectional relative strength, and universe scans.

A rule is an entry of ``RULES``: a function of bars and timeframe that returns a row for each
series with symbol, match, reason and score.  Register another to make it available to scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.values import general
from ..sources.bars import BARS_PER_WEEK, last_bars

#: Thresholds and windows of the rules.
RANGE_BAND, RANGE_WEEKS, LOOKBACK_WEEKS, RS_WEEKS = 0.05, 4, 8, 4
DROP, RALLY, RS_QUANTILE = 0.20, 0.30, 0.90
MA_WINDOW, MA_POINTS = 10, 5
MAX_BARS, FETCH_BUFFER, LEAST_FETCH = 1000, 10, 15
#: The members of the named universes.
UNIVERSES = {
    "top20_alts": ["ETH", "BNB", "SOL", "XRP", "ADA", "AVAX", "DOGE", "DOT", "LINK", "MATIC", "TRX", "LTC", "BCH", "ATOM", "UNI", "ETC", "XLM", "NEAR", "APT", "FIL"],
    "defi_index": ["UNI", "AAVE", "MKR", "SNX", "COMP", "CRV", "SUSHI", "LDO", "CAKE", "DYDX", "1INCH", "BAL", "YFI"],
    "low_caps": ["GALA", "ANKR", "CELR", "OGN", "RVN", "ZIL", "ONE", "HOT", "IOST", "KAVA", "BAND", "OCEAN", "STORJ", "SKL"],
}
NO_OVERLAP = "insufficient overlapping data for relative strength"


def universe(spark: SparkSession, name: str) -> DataFrame:
    """R-09: position and symbol of a named universe."""
    if name not in UNIVERSES:
        raise ValueError(f"unknown universe {name!r}; choose one of {', '.join(UNIVERSES)}")
    return spark.createDataFrame([(name, i, s) for i, s in enumerate(UNIVERSES[name])], "universe string, position int, symbol string")


def bars_of(weeks: int, timeframe: str) -> int:
    """F-13."""
    return weeks * BARS_PER_WEEK[timeframe]


def _ruled(df: DataFrame, rule: str, need: int, match: Column, yes: Column, no: Column, score: Column, unfit: Column | None = None) -> DataFrame:
    """H-01: rows of a rule; series with fewer than ``need`` bars, or unfit ones, don't match."""
    short = (F.col("have") < need) if unfit is None else (F.col("have") < need) | unfit
    lack = F.format_string(f"insufficient data for {rule}: have %d bars, need {need}", "have")
    hit = ~short & F.coalesce(match, F.lit(False))
    return df.select("symbol", hit.alias("match"), F.when(short, lack).when(hit, yes).otherwise(no).alias("reason"), F.when(hit, score).otherwise(0.0).alias("score"))


def range_duration(bars: DataFrame, timeframe: str) -> DataFrame:
    """R-01, A-10: closes of the last weeks stay near their midpoint."""
    need = bars_of(RANGE_WEEKS, timeframe)
    window = last_bars(bars, need)
    ends = window.groupBy("symbol").agg(F.max("have").alias("have"), ((F.max("close") + F.min("close")) / 2).alias("mid"), F.max("close").alias("top"), F.min("close").alias("bottom"))
    # the farthest close from the midpoint is one of the two ends
    found = ends.withColumn("dev", F.when(F.col("mid") > 0, F.greatest(F.abs(F.col("top") - F.col("mid")), F.abs(F.col("bottom") - F.col("mid"))) / F.col("mid")))
    pct = F.col("dev") * 100
    yes = F.format_string(f"{RANGE_WEEKS}+ weeks of closes within ±{RANGE_BAND * 100:.0f}%% of midpoint %s (max dev %.1f%%)", general(F.col("mid")), pct)
    no = F.format_string(f"closes break ±{RANGE_BAND * 100:.0f}%% band over last {RANGE_WEEKS} weeks (max dev %.1f%%)", pct)
    return _ruled(found, "range_duration_gt_4w", need, F.col("dev") <= RANGE_BAND, yes, no, RANGE_BAND - F.col("dev"), unfit=F.col("mid") <= 0)


def moving_average(bars: DataFrame, column: str = "volume", window: int = MA_WINDOW) -> DataFrame:
    """A-06: bars that close a full window, with ``ma`` and its place ``i``."""
    series = W.Window.partitionBy("symbol", "timeframe").orderBy("open_time")
    n = F.row_number().over(series)
    return bars.withColumn("ma", F.avg(column).over(series.rowsBetween(-(window - 1), 0))).withColumn("i", n - window).where("i >= 0")


def volume_declining(bars: DataFrame, timeframe: str) -> DataFrame:
    """R-02, A-07: the moving average of volume falls, by least squares."""
    need = MA_WINDOW + MA_POINTS
    window = last_bars(bars, fetch_limit(need))
    means = window.groupBy("symbol").agg(F.max("have").alias("have"), F.avg("volume").alias("mean"))
    slopes = moving_average(window).groupBy("symbol").agg(F.coalesce(F.regr_slope("ma", F.col("i").cast("double")), F.lit(0.0)).alias("slope"))
    found = means.join(slopes, "symbol", "left").withColumn("slope", F.coalesce("slope", F.lit(0.0))).withColumn("rate", F.when(F.col("mean") > 0, F.col("slope") / F.col("mean")).otherwise(0.0))
    text = lambda word: F.format_string(f"{MA_WINDOW}-bar volume MA slope %.2f%%/bar ({word})", F.col("rate") * 100)
    return _ruled(found, "volume_declining", need, F.col("slope") < 0, text("declining"), text("rising/flat"), -F.col("rate"))


def swings(window: DataFrame) -> DataFrame:
    """A-08, A-09, W-06: largest fall from a running peak and largest rise from a running trough of each series, 0 at least."""
    upto = W.Window.partitionBy("symbol", "timeframe").orderBy("open_time").rowsBetween(W.Window.unboundedPreceding, 0)
    run = window.withColumn("peak", F.max("high").over(upto)).withColumn("trough", F.min("low").over(upto))
    fall = F.max(F.when(F.col("peak") > 0, (F.col("peak") - F.col("low")) / F.col("peak")))
    rise = F.max(F.when(F.col("trough") > 0, (F.col("high") - F.col("trough")) / F.col("trough")))
    floor = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    return run.groupBy("symbol").agg(F.max("have").alias("have"), floor(fall).alias("drawdown"), floor(rise).alias("rally"))


def _swing_rule(name: str, column: str, word: str, least: float) -> Callable[[DataFrame, str], DataFrame]:
    def rule(bars: DataFrame, timeframe: str) -> DataFrame:
        need = bars_of(LOOKBACK_WEEKS, timeframe)
        found = swings(last_bars(bars, need))
        text = F.format_string(f"%.1f%% {word} over prior {LOOKBACK_WEEKS} weeks", F.col(column) * 100)
        return _ruled(found, name, need, F.col(column) >= least, text, F.concat(text, F.lit(f" (< {least * 100:.0f}% threshold)")), F.col(column))

    rule.__doc__ = f"{column} of at least {least} over the last weeks."
    return rule


range_after_drop = _swing_rule("range_after_drop", "drawdown", "drawdown", DROP)  # R-03
range_after_rally = _swing_rule("range_after_rally", "rally", "rally", RALLY)  # R-04

RULES: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "range_duration_gt_4w": range_duration,
    "volume_declining": volume_declining,
    "range_after_drop": range_after_drop,
    "range_after_rally": range_after_rally,
}
RELATIVE_STRENGTH = "relative_strength_top_decile"


def relative_metrics(bars: DataFrame, reference: str, timeframe: str, weeks: int = RS_WEEKS) -> DataFrame:
    """J-02, W-05: change of each symbol's close ratio to the reference over the last aligned bars; null if there are too few."""
    lookback = bars_of(weeks, timeframe)
    base = bars.where((F.col("symbol") == reference) & (F.col("close") > 0)).select("open_time", F.col("close").alias("ref"))
    ratios = bars.where(F.col("close") > 0).join(base, "open_time").select("symbol", "open_time", (F.col("close") / F.col("ref")).alias("ratio"))
    ranked = ratios.withColumn("back", F.row_number().over(W.Window.partitionBy("symbol").orderBy(F.col("open_time").desc())))
    found = ranked.where(F.col("back") <= lookback).groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("ratio", "back").alias("first"), F.min_by("ratio", "back").alias("last"))
    enough = (F.col("n") >= lookback) & (F.lit(lookback) >= 2) & (F.col("first") > 0)
    return found.select("symbol", F.when(enough, F.col("last") / F.col("first") - 1.0).alias("metric"))


def relative_strength(symbols: DataFrame, metrics: DataFrame, weeks: int = RS_WEEKS) -> DataFrame:
    """R-05, A-11: metrics at or above the ninth decile match; the score is the metric either way."""
    of = symbols.join(metrics, "symbol", "left")
    bar = of.agg(F.expr(f"percentile(metric, {RS_QUANTILE})").alias("bar"))  # one row
    found = of.crossJoin(F.broadcast(bar))
    none, hit = F.col("metric").isNull(), F.col("metric") >= F.col("bar")
    text = lambda word: F.format_string(f"RS %+.1f%% vs reference over {weeks}w ({word} top decile, threshold %+.1f%%)", F.col("metric") * 100, F.col("bar") * 100)
    return found.select(*symbols.columns, F.coalesce(hit, F.lit(False)).alias("match"), F.when(none, NO_OVERLAP).when(hit, text("in")).otherwise(text("below")).alias("reason"), F.coalesce("metric", F.lit(0.0)).alias("score"))


def fetch_limit(need: int) -> int:
    """R-06: bars that a scan may look at."""
    return max(LEAST_FETCH, min(MAX_BARS, need + FETCH_BUFFER))


def required_bars(rule: str, timeframe: str) -> int:
    weeks = {"range_duration_gt_4w": RANGE_WEEKS, "range_after_drop": LOOKBACK_WEEKS, "range_after_rally": LOOKBACK_WEEKS, RELATIVE_STRENGTH: RS_WEEKS}
    return MA_WINDOW + MA_POINTS if rule == "volume_declining" else bars_of(weeks[rule], timeframe)


def evaluate(bars: DataFrame, symbols: DataFrame, timeframe: str, rule: str, reference: str | None = None) -> DataFrame:
    """R-06, R-07, J-21: a row for each of ``symbols`` (symbol, position); symbols without bars don't match."""
    if rule not in RULES and rule != RELATIVE_STRENGTH:
        raise ValueError(f"unknown rule {rule!r}; choose one of {', '.join([*RULES, RELATIVE_STRENGTH])}")
    own = bars.where(F.col("timeframe") == timeframe)
    seen = last_bars(own, fetch_limit(required_bars(rule, timeframe))).drop("have")
    if rule == RELATIVE_STRENGTH:
        if reference is None:
            raise ValueError("relative strength needs a reference symbol")
        return relative_strength(symbols, relative_metrics(seen, reference, timeframe))
    found = RULES[rule](seen.join(symbols.select("symbol"), "symbol", "left_semi"), timeframe)
    out = symbols.join(found, "symbol", "left")
    return out.select(*symbols.columns, F.coalesce("match", F.lit(False)).alias("match"), F.coalesce("reason", F.lit("no data")).alias("reason"), F.coalesce("score", F.lit(0.0)).alias("score"))


def scan(bars: DataFrame, symbols: DataFrame, timeframe: str, rule: str, max_results: int = 10, reference: str | None = None) -> DataFrame:
    """R-07, O-01, P-05: matches by score, ties in the order of ``symbols``."""
    if max_results < 1:
        raise ValueError("max_results must be at least 1")
    found = evaluate(bars, symbols, timeframe, rule, reference).where("match")
    return found.orderBy(F.col("score").desc(), "position").limit(max_results)
