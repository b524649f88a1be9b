"""Queries over what is written and read back: logs made from events, published books and pages."""

from __future__ import annotations

import contextlib

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs, records
from ..sources import published
from .common import scratch, table

#: A range over a month's end, whose bounds lie in other months by their own text.
START, END = "2024-02-01T00:30:00+02:00", "2024-03-09T20:00:00-05:00"


def _timed(spark: SparkSession, d: str) -> DataFrame:
    """Events over three months: every third stays in its month, the others come a month and two later."""
    i = F.col("event_id")
    return table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp") + F.make_dt_interval((i % 3 * 31).cast("int")))


def _text(at: str = "at"):
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def s07_signal_lines(spark: SparkSession, d: str) -> DataFrame:
    """A log with blank and broken lines and some without a time, read over a range."""
    i = F.col("event_id")
    e = _timed(spark, d)
    good = F.to_json(F.struct(i.cast("string").alias("signal_id"), F.col("event_type").alias("symbol"), F.when(i % 19 != 0, _text()).alias("logged_at")))
    line = F.when(i % 13 == 0, F.lit('{"signal_id": "broken')).when(i % 17 == 0, F.lit("  ")).otherwise(good)
    folder = scratch(spark, "signals")
    e.select(line.alias("value"), F.date_format("at", "yyyy-MM").alias("month")).write.partitionBy("month").text(folder)
    return records.read_signals(spark, folder, "signal_id string, symbol string, logged_at string", START, END).select("signal_id", "symbol", "logged_at")


def b21_signal_log(spark: SparkSession, d: str) -> DataFrame:
    """Signals written through the log's own rules, and those of a kind and a range listed."""
    i, v = F.col("event_id"), F.col("value")
    e = _timed(spark, d)
    log = logs.SignalLog(spark, scratch(spark, "signal-log"))
    log.append(e.select(i.cast("string").alias("signal_id"), F.regexp_replace("event_type", "_", "").alias("symbol"), F.lit("1h").alias("timeframe"), F.when(i % 2 == 0, "long_spring").otherwise("short_utad").alias("signal_type"), F.array(v, v + 1).alias("entry_zone"), v.alias("invalidation"), F.array(v * 2, v * 3).alias("target_zone"), _text().alias("logged_at")))
    got = log.list(signal_type="long_spring", start=START, end=END)
    return got.select("signal_id", "symbol", "logged_at", F.round(got.target_zone[1], 6).alias("target"))


def b22_journal_log(spark: SparkSession, d: str) -> DataFrame:
    """An analysis for each event, reviews of some of them (and of some that don't exist), listed with the latest review."""
    i = F.col("event_id")
    e = _timed(spark, d)
    log = logs.JournalLog(spark, scratch(spark, "journal"))
    text = lambda x: F.lit(f" {x} ")
    forecast = F.struct(F.when(i % 2 == 0, " up").otherwise("down").alias("direction"), text("t").alias("trigger"), text("i").alias("invalidation"), (i % 10 / 10.0).alias("confidence"))
    log.append(e.select(i.cast("string").alias("analysis_id"), F.col("event_type").alias("symbol"), _text().alias("logged_at"), *(text(c).alias(c) for c in ("timeframe", "effort", "narrative", "structure", "phase")), F.concat(F.lit("m"), i % 4).alias("model"), forecast.alias("forecast")))
    # the analysis of every fourth event has two reviews an hour apart, the later one written first
    said = e.where(i % 4 == 0).select((i + F.when(i % 44 == 0, 10**12).otherwise(0)).cast("string").alias("analysis_id"), F.explode(F.array(F.lit(1), F.lit(0))).alias("hour"), "at")
    log.review(said.select("analysis_id", F.lit("up").alias("realized_direction"), (F.col("hour") == 1).alias("hit_trigger"), F.concat(F.lit("note "), "hour").alias("note"), F.date_format(F.col("at") + F.make_dt_interval(F.lit(40), F.col("hour")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("reviewed_at")))
    got = log.list(model="m0", start=START, end=END)
    return got.select("analysis_id", "symbol", "logged_at", got.forecast.direction.alias("direction"), got.review.note.alias("note"), got.review.hit_trigger.alias("hit"))


def k04_published_books(spark: SparkSession, d: str) -> DataFrame:
    """A book for each customer: published, then changed by its orders and published again, then a change that fails and one that comes too late."""
    book = "id bigint, cash double, next_id bigint"
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(100_000.0).alias("cash"), F.lit(1).cast("bigint").alias("next_id"))
    at = scratch(spark, "books").removeprefix("file://")
    published.publish(c, at)
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("n"))
    changed = published.current(spark, at, book).join(spent, "id", "left")
    published.publish(changed.select("id", (F.col("cash") - F.coalesce("spent", F.lit(0.0))).alias("cash"), (F.col("next_id") + F.coalesce("n", F.lit(0))).alias("next_id")), at, base=1)
    failing = published.current(spark, at, book).withColumn("cash", F.when(F.col("id") % 7 == 0, F.raise_error(F.lit("broken")).cast("double")).otherwise(0.0))
    for wrong, base in ((failing, 2), (c, 1)):
        with contextlib.suppress(PySparkException):
            published.publish(wrong, at, base=base)
    return published.current(spark, at, book).select("id", F.round("cash", 2).alias("cash"), "next_id")


def k08_written_pages(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown file for each benchmark item, and its entry in the manifest."""
    at = scratch(spark, "pages").removeprefix("file://")
    pages = table(spark, d, "benchmark").select(F.format_string("page_%04d.md", "item_id").alias("path"), F.concat(F.lit("# Item "), F.col("item_id").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"))
    published.publish(pages, at, kind="files")
    entries = spark.read.option("multiLine", True).schema("path string, bytes bigint, rows bigint, sha256 string").json(f"file://{at}/version-00000001.json")
    return entries.select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), "bytes", "sha256")


TIMED = "t AS (SELECT *, ts + to_days(CAST(event_id % 3 * 31 AS INT)) AS moved FROM events), r AS (SELECT *, strftime(moved, '%Y-%m-%dT%H:%M:%S.%fZ') AS logged_at FROM t WHERE moved BETWEEN '2024-01-31 22:30:00' AND '2024-03-10 01:00:00')"
SQL = {
    "s07_signal_lines": f"WITH {TIMED} SELECT CAST(event_id AS VARCHAR) AS signal_id, event_type AS symbol, logged_at FROM r WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0",
    "b21_signal_log": f"WITH {TIMED}, n AS (SELECT *, upper(replace(event_type, '_', '')) AS s FROM r) SELECT CAST(event_id AS VARCHAR) AS signal_id, CASE WHEN regexp_matches(s, '.(USDT|USDC|BTC|ETH|BNB)$') THEN s ELSE s || 'USDT' END AS symbol, logged_at, round(value * 3, 6) AS target FROM n WHERE event_id % 2 = 0",
    "b22_journal_log": f"WITH {TIMED} SELECT CAST(event_id AS VARCHAR) AS analysis_id, event_type AS symbol, logged_at, 'up' AS direction, CASE WHEN event_id % 44 <> 0 THEN 'note 1' END AS note, CASE WHEN event_id % 44 <> 0 THEN true END AS hit FROM r WHERE event_id % 4 = 0",
    "k04_published_books": """WITH o AS (SELECT o_custkey AS id, sum(o_totalprice) AS spent, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS id, round(100000 - coalesce(spent, 0), 2) AS cash, 1 + coalesce(n, 0) AS next_id FROM customer LEFT JOIN o ON id = c_custkey""",
    "k08_written_pages": "WITH p AS (SELECT 'page_' || lpad(CAST(item_id AS VARCHAR), 4, '0') || '.md' AS path, '# Item ' || item_id || chr(10) || chr(10) || coalesce(text, '') || chr(10) AS t FROM benchmark) SELECT path, octet_length(encode(t)) AS bytes, sha256(t) AS sha256 FROM p",
}
QUERIES = {name: globals()[name] for name in SQL}
