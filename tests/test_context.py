"""What a card's context says of its chart."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.operators import cards

TEXTS = [*("the daily BTC chart|a BTC/USD daily chart|Weekly $SPX 2019-2020 chart|chart of INDU, chart of DJIA|a 60min ETH chart|HR 4 hour chart|the P&F daily chart|dailyBTC chart|x-daily BTC chart|Daily BTC 2020 2021 chart|daily btc chart|chart  of\tA.B-C and a chart of Ü|éBTC daily chart|intraday A chart\nB monthly chart".split("|")), "", None]


def test_assets_as_the_patterns_say(spark):
    got = {r.x: r.y for r in spark.createDataFrame([(t,) for t in TEXTS], "x string").select("x", cards.chart_assets(F.col("x")).alias("y")).collect()}
    for t in TEXTS:
        named = {m for p in cards.CHARTS for m in re.findall(p.replace("(?U)", ""), t or "")} - set(cards.NO_ASSETS)
        clean = {re.sub("[^A-Z0-9]", "", n.upper()) for n in named}
        assert (got[t] or []) == sorted({"DJIA" if c == "INDU" else c for c in clean} - {""}), t


def test_conflicts(spark):
    cases = [("daily", "BTC", "the daily BTC chart", ""), ("unknown", "Unknown", "the daily BTC chart", "timeframe,asset"), ("weekly", "ETH", "the daily BTC chart", "timeframe,asset"), ("weekly", "", "the daily BTC chart", "timeframe"), ("intraday", "BTC", "the 60 min BTC chart", ""), ("weekly", "ETH", "BTC daily chart and SPX weekly chart", ""), ("unknown", "unknown", "no chart", ""), ("daily", "BTC and ETH", "chart of BTC", "asset")]
    df = spark.createDataFrame(cases, "t string, a string, c string, want string")
    assert [r for r in df.select("*", F.array_join(cards.context_conflicts(F.col("t"), F.col("a"), F.col("c")), ",").alias("got")).collect() if r.got != r.want] == []
