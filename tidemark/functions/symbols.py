"""Symbols, timeframes, sides and directions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quote suffixes in the order in which they are tried, and the endings of leveraged tokens.
QUOTES = ["USDT", "USDC", "BTC", "ETH", "BNB"]
LEVERAGED = ["UP", "DOWN", "BULL", "BEAR"]
TIMEFRAMES = ["1h", "4h", "1d", "1w"]
#: Spellings of the three directions.
DIRECTIONS = {
    "up": ["up", "long", "bull", "bullish", "higher"],
    "down": ["down", "short", "bear", "bearish", "lower"],
    "none": ["none", "flat", "neutral", "wait", "no trade", "no-trade", "stand aside"],
}


def normalize_timeframe(value: str) -> str:
    """F-04 of arguments: a supported timeframe in its usual spelling."""
    got = value.strip().lower()
    if got not in TIMEFRAMES:
        raise ValueError(f"unsupported timeframe {value!r}; choose one of {', '.join(TIMEFRAMES)}")
    return got


def timeframe_of(c: Column) -> Column:
    """S-04: the usual spelling of a timeframe, null if unsupported."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(TIMEFRAMES), low)


def normalize_symbol(c: Column) -> Column:
    """F-01: exchange symbol of a loosely written one, null if it has other characters or is empty."""
    bare = F.upper(F.trim(c))
    joined = F.regexp_replace(bare, "[/._:-]", "")
    quoted = F.lit(False)
    for q in QUOTES:
        quoted = quoted | (joined.endswith(q) & (F.length(joined) > len(q)))
    ok = bare.rlike("^[A-Z0-9/._:-]+$") & (joined != "")
    return F.when(ok, F.when(quoted, joined).otherwise(F.concat(joined, F.lit("USDT"))))


def display_symbol(c: Column) -> Column:
    """F-02: a symbol without the first quote suffix that it ends with."""
    out = F.when(F.lit(False), c)
    for q in QUOTES:
        out = out.when(c.endswith(q) & (F.length(c) > len(q)), F.left(c, F.length(c) - len(q)))
    return out.otherwise(c)


def spread_pair(base: Column, quote: Column) -> Column:
    """F-03: the pair's name, null if a side is invalid or both show the same symbol."""
    a, b = display_symbol(normalize_symbol(base)), display_symbol(normalize_symbol(quote))
    return F.when(a != b, F.concat_ws("/", a, b))


def is_leveraged(c: Column) -> Column:
    """F-04: ends like a leveraged token (plain names that end so are caught as well)."""
    return c.rlike(f"({'|'.join(LEVERAGED)})$")


def side_of(side: Column, signal_type: Column) -> Column:
    """F-09: an explicit side, else the prefix of the signal's type, else null."""
    low = F.lower(signal_type)
    return F.when(side.isin("long", "short"), side).when(low.startswith("long"), "long").when(low.startswith("short"), "short")


def direction_of(c: Column) -> Column:
    """F-16: up, down or none for any known spelling, else null."""
    low = F.lower(F.trim(c))
    out = F.when(F.lit(False), low)
    for name, spellings in DIRECTIONS.items():
        out = out.when(low.isin(spellings), name)
    return out


def is_wait(direction: Column, confidence: Column) -> Column:
    """F-17: a call of none with a confidence of at most 0.35."""
    return F.coalesce((direction_of(direction) == "none") & (confidence <= 0.35), F.lit(False))
