"""Bar sources: OHLCV access, exchange rows and symbols, synthetic series, and bars built from trades and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.symbols import is_leveraged, normalize_timeframe

MAX_LIMIT = 1000
DEFAULT_LIMIT = 200
#: Supported timeframes with their bars a week and milliseconds a bar.
BARS_PER_WEEK = {"1h": 168, "4h": 42, "1d": 7, "1w": 1}
BAR_MS = {"1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000, "1w": 604_800_000}
#: The fields of an exchange row, by place.
KLINE = [("open_time", 0, "bigint"), ("open", 1, "double"), ("high", 2, "double"), ("low", 3, "double"), ("close", 4, "double"), ("volume", 5, "double"), ("close_time", 6, "bigint"), ("quote_volume", 7, "double"), ("trades", 8, "bigint")]


def check_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def timeframes(spark: SparkSession) -> DataFrame:
    """S-04: the supported timeframes."""
    return spark.createDataFrame([(t, n, BAR_MS[t]) for t, n in BARS_PER_WEEK.items()], "timeframe string, bars_per_week int, bar_ms bigint")


def ohlcv(bars: DataFrame, symbol: str, timeframe: str, limit: int = DEFAULT_LIMIT, end_time: int | None = None) -> DataFrame:
    """S-01: the latest ``limit`` bars of a series that open at or before ``end_time``, in ascending order."""
    check_limit(limit)
    found = bars.where((F.col("symbol") == symbol) & (F.col("timeframe") == normalize_timeframe(timeframe)))
    if end_time is not None:
        found = found.where(F.col("open_time") <= end_time)
    return found.orderBy(F.col("open_time").desc()).limit(limit).orderBy("open_time")


def parse_klines(rows: DataFrame, column: str = "kline") -> DataFrame:
    """S-02: exchange rows (JSON arrays of at least nine texts) as bars; shorter ones have ``kline_ok`` false and null fields."""
    parts = F.from_json(column, "array<string>")
    ok = F.coalesce(F.size(parts) >= 9, F.lit(False))
    fields = [F.when(ok, F.get(parts, F.lit(i)).try_cast(kind)).alias(name) for name, i, kind in KLINE]
    return rows.select("*", ok.alias("kline_ok"), *fields)


def supported_symbols(exchange: DataFrame, tickers: DataFrame, limit: int = 50, quote: str = "USDT") -> DataFrame:
    """S-03, J-06, O-02: tradable symbols of a quote asset by 24-hour quote volume; unreadable volumes count 0."""
    check_limit(limit)
    tradable = exchange.where((F.col("status") == "TRADING") & F.coalesce("isSpotTradingAllowed", F.lit(True)) & (F.col("quoteAsset") == quote) & ~is_leveraged(F.col("baseAsset")))
    volume = F.coalesce(F.col("quoteVolume").try_cast("double"), F.lit(0.0))
    joined = tradable.join(tickers.select("symbol", volume.alias("quote_volume")), "symbol")
    out = joined.select("symbol", F.col("baseAsset").alias("base_asset"), F.col("quoteAsset").alias("quote_asset"), "quote_volume")
    return out.orderBy(F.col("quote_volume").desc(), "symbol").limit(limit)


def dry_run_bars(spark: SparkSession, symbol: str, timeframe: str, limit: int, end_time: int) -> DataFrame:
    """S-06: a rising synthetic series that ends at ``end_time``."""
    step, price = BAR_MS[normalize_timeframe(timeframe)], F.lit(5000.0) + F.col("id")
    opens = F.lit(end_time) - (limit - 1 - F.col("id")) * step
    return spark.range(check_limit(limit)).select(
        F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), opens.alias("open_time"), price.alias("open"), (price + 10).alias("high"), (price - 10).alias("low"), (price + 5).alias("close"), (F.lit(1000.0) + F.col("id")).alias("volume"), (opens + step - 1).alias("close_time")
    )


def with_index(bars: DataFrame) -> DataFrame:
    """Add ``bar_idx``, from 0 in each series by time, and ``n_bars``, its length."""
    series = W.Window.partitionBy("symbol", "timeframe")
    return bars.withColumn("bar_idx", F.row_number().over(series.orderBy("open_time")) - 1).withColumn("n_bars", F.count("*").over(series))


def last_bars(bars: DataFrame, need: int) -> DataFrame:
    """W-01: the last ``need`` bars of each series, with ``have``, how many there were."""
    series = W.Window.partitionBy("symbol", "timeframe")
    ranked = bars.withColumn("back", F.row_number().over(series.orderBy(F.col("open_time").desc()))).withColumn("have", F.count("*").over(series))
    return ranked.where(F.col("back") <= need).drop("back")


def _bars(ticks: DataFrame, open_time: Column, timeframe: str, price: str, order: list[str], volume: Column) -> DataFrame:
    first = F.struct(*order)
    found = ticks.withColumn("open_time", open_time).groupBy("symbol", "open_time").agg(
        F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, first).alias("close"), F.sum(volume).alias("volume"), F.count("*").alias("trades")
    )
    return found.select("symbol", F.lit(timeframe).alias("timeframe"), "open_time", "open", "high", "low", "close", "volume", "trades")


def daily_bars(lineitem: DataFrame, part: DataFrame, calm: bool = False, by: str = "p_type") -> DataFrame:
    """Daily bars of unit prices by part type; ``calm`` takes prices near 100 in place of the wide ones.

    Keys of line items repeat, so the price itself is the last tie-break of a day's first and last trade.
    """
    px = 100 * (1 - F.col("l_discount")) if calm else F.col("l_extendedprice") / F.col("l_quantity")
    ticks = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col(by).alias("symbol"), F.col("l_shipdate").cast("date").alias("day"), px.alias("px"), F.col("l_quantity").alias("qty"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"))
    return _bars(ticks, F.unix_millis(F.col("day").cast("timestamp")), "1d", "px", ["k1", "k2", "px"], F.col("qty"))


def hourly_bars(events: DataFrame) -> DataFrame:
    """Hourly bars of event values by event type; every event trades one unit."""
    ticks = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    return _bars(ticks, F.unix_millis(F.date_trunc("hour", "ts")), "1h", "value", ["event_id"], F.lit(1.0))


VIOLATIONS = ["time_not_increasing", "price_not_positive", "volume_negative", "high_below_body", "low_above_body", "low_above_high"]


def violations(bars: DataFrame) -> DataFrame:
    """F-14, W-07: the first broken rule of each bar, or null."""
    before = F.lag("open_time").over(W.Window.partitionBy("symbol", "timeframe").orderBy("seq"))
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    missing = o.isNull() | h.isNull() | lo.isNull() | c.isNull() | v.isNull() | F.col("open_time").isNull()
    tests = [before >= F.col("open_time"), (o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0), v < 0, h < F.greatest(o, c), lo > F.least(o, c), lo > h]
    rule = F.when(missing, F.lit("field_missing"))
    for name, broken in zip(VIOLATIONS, tests, strict=True):
        rule = rule.when(broken, F.lit(name))
    return bars.withColumn("violation", rule)
