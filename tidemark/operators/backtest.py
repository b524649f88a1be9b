"""Walk-forward trade simulation: signals with stops and targets, breakout rules, and replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.symbols import side_of
from ..functions.values import filled, iso_ms, time_problem, trade_return
from ..sources.bars import last_bars, with_index


#: Milliseconds of a stretch of time in which signals and bars of a series are merged.
STRETCH_MS = 30 * 86_400_000
#: Bars of a block, blocks of a block of blocks, and so on.
FAN = 64
SERIES = ["symbol", "timeframe"]


def next_bars(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """J-03: each signal (symbol, timeframe, time_ms) with the first bar that opens strictly later, as struct ``bar`` or null.

    Signals and bars are merged in time order within a stretch of a series, so no task sorts a whole series;
    a bar at a signal's own time comes before it.  Behind the last bar of a stretch comes the first bar of the
    next one that has any, carried back over the stretches, of which a series has one row each.
    """
    cols = [c for c in bars.columns if c not in SERIES]
    stretch = lambda t: F.floor(t / STRETCH_MS)
    none = F.lit(None).cast(bars.select(F.struct(*cols)).schema[0].dataType)
    b = bars.select(*SERIES, F.col("open_time").alias("_t"), F.lit(1).alias("_k"), F.struct(*cols).alias("bar"), F.lit(None).cast(signals.select(F.struct("*")).schema[0].dataType).alias("_s")).withColumn("_n", stretch(F.col("_t")))
    s = signals.select(*SERIES, F.col("time_ms").alias("_t"), F.lit(0).alias("_k"), none.alias("bar"), F.struct("*").alias("_s")).withColumn("_n", stretch(F.col("_t")))
    later = W.Window.partitionBy(*SERIES, "_n").orderBy(F.col("_t").desc(), F.col("_k").asc()).rowsBetween(W.Window.unboundedPreceding, 0)
    merged = b.unionByName(s).withColumn("bar", F.last("bar", ignorenulls=True).over(later)).where("_k = 0")
    firsts = b.groupBy(*SERIES, "_n").agg(F.min_by("bar", "_t").alias("_first")).unionByName(s.select(*SERIES, "_n", none.alias("_first")).distinct())
    firsts = firsts.groupBy(*SERIES, "_n").agg(F.first("_first", ignorenulls=True).alias("_first"))
    beyond = F.first("_first", ignorenulls=True).over(W.Window.partitionBy(*SERIES).orderBy("_n").rowsBetween(1, W.Window.unboundedFollowing))
    return merged.join(firsts.select(*SERIES, "_n", beyond.alias("_beyond")), [*SERIES, "_n"], "left").select("_s.*", F.coalesce("bar", "_beyond").alias("bar"))


def usable_signals(signals: DataFrame) -> DataFrame:
    """F-06, F-09: add side, time_ms and ``skip``, the first reason not to trade, or null."""
    no_series = F.col("symbol").isNull() | F.col("timeframe").isNull()
    side = side_of(F.col("side") if "side" in signals.columns else F.lit(None).cast("string"), F.col("signal_type"))
    problem = time_problem(F.col("logged_at"))
    out = signals.withColumn("side", side).withColumn("time_ms", iso_ms(F.col("logged_at")))
    return out.withColumn("skip", F.when(no_series, "missing_symbol_or_timeframe").when(problem.isNotNull(), problem).when(F.col("side").isNull(), "unresolvable_side"))


def _touch(side: Column, stop: Column, target: Column) -> Column:
    """Q-02: what a bar does to a trade: its stop comes before its target."""
    long = F.when(F.col("low") <= stop, F.struct(F.lit("hit_sl").alias("outcome"), stop.alias("price"))).when(F.col("high") >= target, F.struct(F.lit("hit_tp").alias("outcome"), target.alias("price")))
    short = F.when(F.col("high") >= stop, F.struct(F.lit("hit_sl").alias("outcome"), stop.alias("price"))).when(F.col("low") <= target, F.struct(F.lit("hit_tp").alias("outcome"), target.alias("price")))
    return F.when(side == "long", long).otherwise(short)


def bar_blocks(indexed: DataFrame) -> list[DataFrame]:
    """Blocks of bars, blocks of those, and so on up to one for the longest series.

    A block (symbol, timeframe, node) has its ``kids`` in order: ``at`` (bar number, or number of a lower
    block), and their least low and greatest high.  Each level is one aggregate of the one below it.
    """
    longest = indexed.groupBy(*SERIES).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    kids = indexed.select(*SERIES, F.col("bar_idx").cast("long").alias("at"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    levels, reach = [], 1
    while not levels or reach < longest:
        level = kids.groupBy(*SERIES, F.floor(F.col("at") / FAN).alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", "lo", "hi"))).alias("kids"))
        levels.append(level)
        kids = level.select(*SERIES, F.col("node").alias("at"), F.array_min("kids.lo").alias("lo"), F.array_max("kids.hi").alias("hi"))
        reach *= FAN
    return levels


def first_touch(trades: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``trades`` with ``touch_idx``: the first bar in [from_idx, last_idx] that reaches ``floor`` or ``ceil``, or null.

    A trade looks into its own block from its own bar on, then into the blocks that follow within the block
    of blocks, and so on upwards until one may hold a touch; from there it goes down again into the first kid
    that does.  So it meets one block a level each way, whatever its length, and never a row a bar.
    A null floor and ceiling touch nothing.
    """
    row = F.col("_row")
    hits = lambda k: (k["lo"] <= row["floor"]) | (k["hi"] >= row["ceil"])
    # at: where the search goes on (bars, then blocks); level: where it found a kid; found: that kid
    out = trades.select(*SERIES, F.struct("*").alias("_row"), F.col("from_idx").cast("long").alias("at"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("found"))
    # trades that don't look on a level meet nothing there; their keys are spread
    idle = -1 - F.pmod(F.xxhash64(row["from_idx"], row["floor"], row["ceil"]), F.lit(1 << 20))
    leveled = row["floor"].isNotNull() | row["ceil"].isNotNull()

    def look(df: DataFrame, level: int, looks: Column, node: Column, kid: Callable[[Column], Column]) -> DataFrame:
        joined = df.withColumn("node", F.when(looks, node).otherwise(idle)).join(levels[level], [*SERIES, "node"], "left")
        return joined.withColumn("hit", F.get(F.filter("kids", lambda k: kid(k) & hits(k)), F.lit(0))["at"]).drop("kids", "node")

    for k in range(len(levels)):
        up = F.floor(F.col("at") / FAN)
        out = look(out, k, leveled & F.col("level").isNull() & (F.col("at") * FAN**k <= row["last_idx"]), up, lambda x: x["at"] >= F.col("at"))
        out = out.select(*SERIES, "_row", F.when(F.col("level").isNull(), up + 1).otherwise(F.col("at")).alias("at"), F.coalesce("level", F.when(F.col("hit").isNotNull(), k)).alias("level"), F.coalesce("found", "hit").alias("found"))
    for k in range(len(levels) - 1, 0, -1):
        down = F.coalesce(F.col("level") >= k, F.lit(False))
        out = look(out, k - 1, down, F.col("found"), lambda _: F.lit(True)).withColumn("found", F.when(down, F.col("hit")).otherwise(F.col("found"))).drop("hit")
    return out.select("_row.*", F.when(F.col("found") <= row["last_idx"], F.col("found")).alias("touch_idx"))


def resolve(entered: DataFrame, indexed: DataFrame, max_holding: int | None) -> DataFrame:
    """J-04, B-03: exit of each trade (symbol, timeframe, trade_id, side, entry_idx, stop, target): exit_idx, exit_price, exit_time, outcome.

    The first bar that touches a level is found by blocks of bars; then a trade meets the one bar of its exit.
    """
    size = indexed.groupBy(*SERIES).agg(F.max("bar_idx").alias("last_bar"))
    held = entered.join(size, SERIES)
    cut = F.lit(max_holding is not None) & (F.col("entry_idx") + F.lit(max_holding or 0) < F.col("last_bar"))
    leveled = F.col("stop").isNotNull() & F.col("target").isNotNull()
    held = held.withColumn("last_idx", F.when(cut, F.col("entry_idx") + F.lit(max_holding or 0)).otherwise(F.col("last_bar"))).withColumn("no_exit", F.when(~leveled, "no_exit_levels").when(cut, "timeout").otherwise("data_exhausted"))
    long = F.col("side") == "long"
    low, high = F.when(long, F.col("stop")).otherwise(F.col("target")), F.when(long, F.col("target")).otherwise(F.col("stop"))
    banded = held.withColumns({"from_idx": F.col("entry_idx"), "floor": F.when(leveled, low), "ceil": F.when(leveled, high)})
    touched = first_touch(banded, bar_blocks(indexed)).withColumn("exit_idx", F.coalesce("touch_idx", F.col("last_idx").cast("long")))
    b = indexed.select(*SERIES, F.col("bar_idx").cast("long").alias("exit_idx"), F.col("open_time").alias("exit_time"), "high", "low", "close")
    met = touched.join(b, [*SERIES, "exit_idx"])
    hit = F.when(F.col("touch_idx").isNotNull(), _touch(F.col("side"), F.col("stop"), F.col("target")))
    return met.select(*entered.columns, F.col("exit_idx").cast("int").alias("exit_idx"), F.coalesce(hit["price"], "close").alias("exit_price"), "exit_time", F.coalesce(hit["outcome"], "no_exit").alias("outcome"))


def latest_bars(bars: DataFrame, candle_limit: int | None) -> DataFrame:
    """The last ``candle_limit`` bars of each series; all of them without one."""
    return bars if candle_limit is None else last_bars(bars, candle_limit).drop("have")


def filtered_signals(signals: DataFrame, symbol: str | None = None, signal_type: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """P-01: signals of a symbol, a type and a time range, both ends included; one without a readable time lies in no range."""
    at = F.try_to_timestamp("logged_at")
    for wanted, keep in ((symbol, F.col("symbol") == symbol), (signal_type, F.col("signal_type") == signal_type), (start, at >= F.try_to_timestamp(F.lit(start))), (end, at <= F.try_to_timestamp(F.lit(end)))):
        signals = signals if wanted is None else signals.where(keep)
    return signals


FILL_RULES = ("next_bar_open", "fixed_slippage_0.1pct")


def check_fill_rule(rule: str) -> str:
    if rule not in FILL_RULES:
        raise ValueError(f"fill_rule must be one of {', '.join(FILL_RULES)}, not {rule!r}")
    return rule


def backtest_signals(
    signals: DataFrame, bars: DataFrame, fill_rule: str = "next_bar_open", max_holding: int | None = None, symbol: str | None = None, signal_type: str | None = None, start: str | None = None, end: str | None = None, candle_limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """B-01, H-06: (trades, skipped).  ``signals`` has signal_id, seq, symbol, timeframe, logged_at, signal_type, invalidation, target_zone.

    Signals may be narrowed to a symbol, a type and a time range, bars to the last ``candle_limit`` of each series.
    Every signal that is left is in one of the two: skipped has signal_id and reason, the first that holds.
    """
    check_fill_rule(fill_rule)
    if max_holding is not None and max_holding < 1:
        raise ValueError("max_holding must be at least 1")
    judged = usable_signals(filtered_signals(signals, symbol, signal_type, start, end))
    indexed = with_index(latest_bars(bars, candle_limit))
    found = next_bars(judged.where("skip is null").drop("skip"), indexed.select("symbol", "timeframe", "bar_idx", "open_time", "open"))
    reason = F.when(F.col("bar").isNull(), "no_entry_candle").when(F.col("bar.open") <= 0, "invalid_entry")
    found = found.withColumn("reason", reason)
    zone = F.when(F.size("target_zone") > 0, F.col("target_zone"))
    entered = found.where("reason is null").select(
        F.col("signal_id").alias("trade_id"), "symbol", "timeframe", "seq", "side", F.col("bar.bar_idx").alias("entry_idx"), F.col("bar.open_time").alias("entry_time"), filled(F.col("bar.open"), F.col("side"), fill_rule).alias("entry_price"),
        F.col("invalidation").alias("stop"), F.when(F.col("side") == "long", F.array_min(zone)).otherwise(F.array_max(zone)).alias("target"), *[c for c in ("tactical_quality", "phase") if c in signals.columns],
    )
    trades = resolve(entered, indexed, max_holding).withColumn("pnl_pct", trade_return(F.col("side"), F.col("entry_price"), F.col("exit_price"))).withColumnRenamed("trade_id", "signal_id")
    skipped = judged.where("skip is not null").select("signal_id", F.col("skip").alias("reason")).unionByName(found.where("reason is not null").select("signal_id", "reason"))
    return trades, skipped


def skip_counts(signals: DataFrame, trades: DataFrame, skipped: DataFrame) -> DataFrame:
    """A-05: how many signals were considered, executed, and skipped for each reason."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("reason"), "n")
    return one(signals, "considered").unionByName(one(trades, "executed")).unionByName(skipped.groupBy("reason").agg(F.count("*").alias("n")))


def breakouts(bars: DataFrame, side: str, lookback: int) -> DataFrame:
    """W-03: bars that close beyond the prior ``lookback`` bars' highs (long) or lows (short)."""
    if lookback < 1:
        raise ValueError("lookback must be at least 1")
    prior = W.Window.partitionBy("symbol", "timeframe").orderBy("open_time").rowsBetween(-lookback, -1)
    level = F.max("high").over(prior) if side == "long" else F.min("low").over(prior)
    beyond = F.col("close") > F.col("level") if side == "long" else F.col("close") < F.col("level")
    return with_index(bars).withColumn("level", level).where((F.col("bar_idx") >= lookback) & beyond)


def apart(triggers: DataFrame, holding: int) -> DataFrame:
    """W-04: triggers that don't fall into the trade of an earlier one: the next is ``holding`` + 2 bars on at least.

    The choice is sequential within a series; only bar numbers of triggers are folded.
    """
    gap = holding + 2
    chosen = F.aggregate(
        F.array_sort(F.collect_list("bar_idx")),
        F.struct(F.lit(0).cast("int").alias("next"), F.array().cast("array<int>").alias("out")),
        lambda a, i: F.when(i >= a["next"], F.struct((i + gap).cast("int").alias("next"), F.concat(a["out"], F.array(i)).alias("out"))).otherwise(a),
        lambda a: a["out"],
    )
    return triggers.groupBy("symbol", "timeframe").agg(chosen.alias("c")).select("symbol", "timeframe", F.explode("c").alias("bar_idx"))


def backtest_rule(
    bars: DataFrame, side: str, lookback: int, holding: int, fill_rule: str = "next_bar_open", symbols: list[str] | None = None, timeframe: str | None = None, start: str | None = None, end: str | None = None, candle_limit: int | None = None
) -> DataFrame:
    """B-02, W-08: trades of a breakout rule, entered on the bar after the trigger and held ``holding`` bars.

    Bars may be narrowed to symbols and a timeframe, then to the last ``candle_limit`` of each series, then to a
    time range of their opening, both ends included; what is left is all the rule knows.
    """
    check_fill_rule(fill_rule)
    if side not in ("long", "short"):
        raise ValueError(f"side must be long or short, not {side!r}")
    if holding < 1:
        raise ValueError("holding must be at least 1")
    for wanted, keep in ((symbols, F.col("symbol").isin(symbols or [])), (timeframe, F.col("timeframe") == timeframe)):
        bars = bars if wanted is None else bars.where(keep)
    bars = latest_bars(bars, candle_limit)
    for bound, keep in ((start, lambda t: F.col("open_time") >= t), (end, lambda t: F.col("open_time") <= t)):
        bars = bars if bound is None else bars.where(keep(iso_ms(F.lit(bound))))
    chosen = apart(breakouts(bars, side, lookback), holding)
    b = with_index(bars).select("symbol", "timeframe", "bar_idx", "open_time", "open", "close", "n_bars")
    key = SERIES
    entry = chosen.withColumn("entry_idx", F.col("bar_idx") + 1).drop("bar_idx").join(b.select(*key, F.col("bar_idx").alias("entry_idx"), F.col("open_time").alias("entry_time"), "open", "n_bars"), [*key, "entry_idx"])
    entry = entry.where("open > 0").withColumn("exit_idx", F.least(F.col("entry_idx") + holding, F.col("n_bars") - 1)).withColumn("outcome", F.when(F.col("entry_idx") + holding <= F.col("n_bars") - 1, "timeout").otherwise("data_exhausted"))
    out = entry.join(b.select(*key, F.col("bar_idx").alias("exit_idx"), F.col("open_time").alias("exit_time"), F.col("close").alias("exit_price")), [*key, "exit_idx"])
    out = out.withColumn("side", F.lit(side)).withColumn("entry_price", filled(F.col("open"), F.lit(side), fill_rule)).withColumn("seq", F.col("entry_idx"))
    return out.withColumn("pnl_pct", trade_return(F.col("side"), F.col("entry_price"), F.col("exit_price"))).select(*key, "side", "seq", "entry_idx", "entry_time", "entry_price", "exit_time", "exit_price", "pnl_pct", "outcome")


def replay(signals: DataFrame, walk: DataFrame) -> DataFrame:
    """B-04, B-05: outcome of each signal on its own bars: id, side, stop, target against id, i (from 1), high, low.

    ``open`` where neither level is touched; ``resolved_at`` is the place of the bar that does.
    """
    hit = _touch(F.col("side"), F.col("stop"), F.col("target"))
    met = signals.join(walk, "id").withColumn("hit", hit).where("hit is not null").groupBy("id").agg(F.min(F.struct(F.col("i"), F.col("hit.outcome").alias("outcome"))).alias("x"))
    return signals.join(met, "id", "left").select(*signals.columns, F.coalesce("x.outcome", F.lit("open")).alias("outcome"), F.col("x.i").alias("resolved_at"))
