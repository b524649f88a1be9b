"""Times, numbers, money and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLIPPAGE = 0.001


def iso_ms(c: Column) -> Column:
    """F-05: epoch milliseconds of an ISO time, naive ones as UTC, null if unreadable."""
    return F.unix_millis(F.try_to_timestamp(c))


def utc_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def time_problem(c: Column) -> Column:
    """F-06: why a signal's time can't be used, or null."""
    return F.when(c.isNull() | (F.trim(c) == ""), "missing_timestamp").when(iso_ms(c).isNull(), "unparseable_timestamp")


def end_time_ms(c: Column) -> Column:
    """F-07: epoch milliseconds of whole numbers or ISO times; only positive ones stand."""
    got = F.coalesce(c.try_cast("bigint"), iso_ms(c))
    return F.when(got > 0, got)


def cutoff_ms(c: Column) -> Column:
    """F-08: epoch milliseconds of a cutoff; a bare day begins at midnight UTC."""
    return F.coalesce(c.try_cast("bigint"), F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso_ms(F.concat(c, F.lit("T00:00:00Z")))).otherwise(iso_ms(c)))


def month_of(logged_at: Column) -> Column:
    """H-17: the month file that a record belongs to."""
    return F.date_format(F.try_to_timestamp(logged_at), "yyyy-MM")


def filled(price: Column, side: Column, rule: str) -> Column:
    """F-10: entry price; ``fixed_slippage_0.1pct`` moves it against the trader."""
    if rule != "fixed_slippage_0.1pct":
        return price
    return F.when(side == "long", price * (1 + SLIPPAGE)).otherwise(price * (1 - SLIPPAGE))


def trade_return(side: Column, entry: Column, leave: Column) -> Column:
    """F-11: fractional return; 0 for an entry of 0."""
    return F.when(entry == 0, 0.0).when(side == "long", (leave - entry) / entry).otherwise((entry - leave) / entry)


def pnl(side: Column, size: Column, entry: Column, mark: Column) -> Column:
    """F-12: absolute profit of a position; null for an unknown side."""
    return F.when(side == "long", (mark - entry) * size).when(side == "short", (entry - mark) * size)


def finite(c: Column) -> Column:
    """F-15: a number that is neither NaN nor infinite, else null."""
    got = c.try_cast("double")
    return F.when(~F.isnan(got) & (F.abs(got) != float("inf")), got)


def positive(c: Column) -> Column:
    got = finite(c)
    return F.when(got > 0, got)


def case_index(case_id: Column, n: int = 6) -> Column:
    """F-18: a stable place of a case among ``n``."""
    return (F.conv(F.substring(F.sha2(case_id, 256), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """F-19: dollars for a call; null if unpriced or a count is missing."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def roi(score: Column, cost: Column, tokens: Column, priced: Column, digits: int | None = 4) -> Column:
    """F-20: score a dollar for priced models, else score a thousand tokens."""
    by_cost = F.when(cost > 0, score / cost)
    by_tokens = F.when(tokens > 0, score / (tokens / 1000))
    return rounded(F.when(priced, by_cost).otherwise(by_tokens), digits)


def run_id(*parts: Column) -> Column:
    """F-21."""
    return F.concat_ws("__", *parts)


def shown(c: Column, digits: int) -> Column:
    """F-23: fixed decimals, N/A for null."""
    return F.when(c.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", c))


#: Timeframes known by name, and units with the spelling that counts.
NAMED_TIMEFRAMES = ["daily", "weekly", "monthly", "yearly", "intraday"]
TIME_UNITS = {"minute": "minute", "min": "minute", "hour": "hour", "hr": "hour", "day": "day"}


def chart_timeframe(c: Column) -> Column:
    """F-24: a chart's timeframe in one spelling, whatever chart form follows it; null for anything else."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r" (point([- ]and[- ]| & )figure|p&f|pnf)$", "")
    counted = f"^([0-9]{{1,3}})[- ]?({'|'.join(TIME_UNITS)})$"
    unit = F.create_map(*(F.lit(x) for pair in TIME_UNITS.items() for x in pair))[F.regexp_extract(bare, counted, 2)]
    number = F.regexp_extract(bare, counted, 1).try_cast("int").cast("string")
    return F.when(bare.isin(NAMED_TIMEFRAMES), bare).otherwise(F.concat(number, F.lit("-"), unit))


def general(c: Column, digits: int = 4) -> Column:
    """A positive number in ``digits`` significant digits, without trailing zeros; with an exponent where it is below -4 or from ``digits`` on."""
    shown_e = F.format_string(f"%.{digits - 1}e", c.cast("double"))
    mantissa, exponent = F.split_part(shown_e, F.lit("e"), F.lit(1)), F.split_part(shown_e, F.lit("e"), F.lit(2)).try_cast("int")
    figures = F.replace(mantissa, F.lit("."), F.lit(""))
    bare = lambda x: F.rtrim(F.rtrim(x, F.lit("0")), F.lit("."))  # noqa: E731  (there is always a point)
    plain = F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0))), figures)).otherwise(F.concat(F.substring(figures, F.lit(1), exponent + 1), F.lit("."), F.substring(figures, exponent + 2, F.lit(digits))))
    return F.when((exponent < -4) | (exponent >= digits), F.concat(bare(mantissa), F.lit("e"), F.split_part(shown_e, F.lit("e"), F.lit(2)))).otherwise(bare(plain))


def asset_name(c: Column) -> Column:
    """F-25: letters and digits in upper case, with the one alias."""
    bare = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(bare == "INDU", "DJIA").otherwise(bare)


#: What stands between the assets of a declaration.
BETWEEN_ASSETS = r"(?i)\s+(?:/|&|and)\s+|,\s*"


def asset_parts(c: Column) -> Column:
    """F-25, U-04: the set of assets that a declaration names, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(c, BETWEEN_ASSETS), lambda x: F.trim(x) != ""), asset_name)))


def collapsed(c: Column) -> Column:
    """F-27: white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def alnum(c: Column) -> Column:
    """F-27: lower case, everything but ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tight(c: Column) -> Column:
    """F-27: no space before punctuation."""
    return F.regexp_replace(collapsed(c), r"\s+([,.;:!?)])", "$1")


def book_pages(label: Column) -> Column:
    """F-28: pages that a label with a ``p.`` names, ranges expanded, in order, once each; reversed ranges name none."""
    ranges = F.regexp_extract_all(label, F.lit(r"([0-9]{1,3}(?:\s*[-–]\s*[0-9]{1,3})?)"), F.lit(1))

    def pages(x: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1)), lambda e: e.cast("int"))
        low, high = F.element_at(ends, 1), F.element_at(ends, -1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    found = F.array_distinct(F.flatten(F.transform(ranges, pages)))
    return F.when(F.contains(F.lower(label), F.lit("p.")), found).otherwise(F.array().cast("array<int>"))


def file_name(url: Column, content_type: Column) -> Column:
    """F-29: a file name from a URL: clean stem, eight digits of its hash, extension by type, else by suffix."""
    last = F.element_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1)
    suffix = F.lower(F.regexp_extract(last, r"\.([A-Za-z0-9]{1,5})$", 1))
    stem = F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]{1,5}$", ""), "[^A-Za-z0-9_-]+", "-")
    kind = F.regexp_extract(F.lower(content_type), "^image/(png|jpeg|gif|webp)", 1)
    ext = F.when(kind == "jpeg", "jpg").when(kind != "", kind).when(suffix != "", suffix).otherwise("img")
    return F.concat(F.when(stem == "", "image").otherwise(stem), F.lit("-"), F.substring(F.sha1(url), 1, 8), F.lit("."), ext)


def redacted(stderr: Column, lines: int = 20) -> Column:
    """F-30: the last lines of a log, those that may hold a key replaced."""
    rows = F.split(stderr, "\n")
    tail = F.slice(rows, F.greatest(F.size(rows) - lines + 1, F.lit(1)), lines)
    return F.array_join(F.transform(tail, lambda x: F.when(F.lower(x).rlike("api_key|authorization|token="), "[redacted]").otherwise(x)), "\n")


def truncated(c: Column, head: int) -> Column:
    """H-40."""
    return F.left(c, F.lit(head))


def usage_tokens(primary: Column, other: Column) -> Column:
    """H-39: a token count under either name, 0 if neither stands."""
    return F.coalesce(primary, other, F.lit(0))
