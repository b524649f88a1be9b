"""Small cases with known answers, and the traps of order, ties and bounds."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html, symbols, values
from tidemark.operators import backtest, cards, evaluation, ingest, ledgers, rules, spread, stats, wiki
from tidemark.sources import bars as src

DAY = 86_400_000
BAR = "symbol string, timeframe string, open_time bigint, open double, high double, low double, close double, volume double"


def series(spark, closes, symbol="A", highs=None, lows=None, volumes=None, opens=None):
    rows = [(symbol, "1d", i * DAY, float((opens or closes)[i]), float((highs or closes)[i]), float((lows or closes)[i]), float(c), float((volumes or [1.0] * len(closes))[i])) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("BTC", "BTCUSDT"), ("BTC/USDT", "BTCUSDT"), (" eth/usdt ", "ETHUSDT"), ("ETHBTC", "ETHBTC"), ("WBTC", "WBTC"), ("a b", None), ("", None)])
def test_symbols(spark, raw, want):
    assert one(spark, symbols.normalize_symbol(F.lit(raw))) == want


def test_scalar_functions(spark):
    assert one(spark, symbols.spread_pair(F.lit("eth"), F.lit("ETHUSDT"))) is None
    assert one(spark, symbols.spread_pair(F.lit("eth"), F.lit("btc"))) == "ETH/BTC"
    assert one(spark, values.time_problem(F.lit("later"))) == "unparseable_timestamp"
    assert one(spark, values.time_problem(F.lit(None).cast("string"))) == "missing_timestamp"
    assert one(spark, values.cutoff_ms(F.lit("1970-01-02"))) == DAY
    assert one(spark, values.iso_ms(F.lit("1970-01-02T00:00:00Z"))) == DAY
    assert one(spark, values.end_time_ms(F.lit("-5"))) is None
    assert one(spark, values.book_pages(F.lit("pp. 3-5, 4, 9-7 p. 12"))) == [3, 4, 5, 12]
    assert one(spark, values.book_pages(F.lit("3-5"))) == []
    assert one(spark, values.asset_parts(F.lit("INDU & Gold / gold"))) == ["DJIA", "GOLD"]
    assert one(spark, values.redacted(F.lit("a\nAPI_KEY=1\nb"), 2)) == "[redacted]\nb"
    assert one(spark, values.chart_timeframe(F.lit("60 min"))) == "60-minute"
    assert one(spark, values.chart_timeframe(F.lit("P&F"))) is None
    assert one(spark, values.tight(F.lit("a , b ."))) == "a, b."
    assert one(spark, values.shown(F.lit(None).cast("double"), 2)) == "N/A"
    assert one(spark, values.token_cost(F.lit(1000), F.lit(2000), F.lit(5.0), F.lit(25.0))) == pytest.approx(0.055)
    assert one(spark, values.finite(F.lit("NaN"))) is None
    assert one(spark, values.positive(F.lit("-1"))) is None
    assert one(spark, values.file_name(F.lit("http://h/a b.PNG?x=1"), F.lit(None).cast("string"))).startswith("a-b-")
    assert one(spark, symbols.direction_of(F.lit(" Stand aside "))) == "none"
    assert one(spark, symbols.is_wait(F.lit("wait"), F.lit(0.35))) is True
    assert one(spark, symbols.is_wait(F.lit("wait"), F.lit(None).cast("double"))) is False


def test_limits():
    for bad in (0, 1001, True):
        with pytest.raises(ValueError):
            src.check_limit(bad)
    with pytest.raises(ValueError):
        symbols.normalize_timeframe("2h")
    assert rules.fetch_limit(15) == 25 and rules.fetch_limit(1344) == 1000 and rules.fetch_limit(1) == 15


def test_ohlcv_and_klines(spark):
    b = series(spark, range(1, 8))
    assert [r.close for r in src.ohlcv(b, "A", " 1D ", 3, 4 * DAY).collect()] == [3.0, 4.0, 5.0]
    rows = src.parse_klines(spark.createDataFrame([('["1","2","3","4","5","6","7","8","9"]',), ('["1"]',), (None,)], "kline string")).collect()
    assert [r.kline_ok for r in rows] == [True, False, False] and rows[0].close == 5.0


def test_top_symbols(spark):
    ex = spark.createDataFrame([(f"ASSET{i}USDT", f"ASSET{i}", "USDT", "TRADING", None) for i in range(60)] + [("XUPUSDT", "XUP", "USDT", "TRADING", True), ("BADUSDT", "BAD", "USDT", "TRADING", False)], "symbol string, baseAsset string, quoteAsset string, status string, isSpotTradingAllowed boolean")
    tick = spark.createDataFrame([(f"ASSET{i}USDT", str(i)) for i in range(60)] + [("XUPUSDT", "999"), ("BADUSDT", "999")], "symbol string, quoteVolume string")
    assert [r.base_asset for r in src.supported_symbols(ex, tick, 50).collect()] == [f"ASSET{i}" for i in range(59, 9, -1)]


def test_rules(spark):
    flat = rules.range_duration(series(spark, [98 + i % 5 for i in range(28)]), "1d").first()
    assert flat.match and flat.score == pytest.approx(0.05 - 2 / 100) and "4+ weeks" in flat.reason
    assert "insufficient data for range_duration_gt_4w: have 3 bars, need 28" == rules.range_duration(series(spark, [1, 2, 3]), "1d").first().reason
    down = rules.volume_declining(series(spark, [1.0] * 20, volumes=[2000 - 90 * i for i in range(20)]), "1d").first()
    assert down.match and "declining" in down.reason
    drop = rules.range_after_drop(series(spark, [100] * 28 + [60] * 28), "1d").first()
    assert drop.match and drop.score == pytest.approx(0.4)
    assert not rules.range_after_rally(series(spark, [100] * 28 + [60] * 28), "1d").first().match
    assert rules.range_after_rally(series(spark, [60] * 28 + [90] * 28), "1d").first().score == pytest.approx(0.5)


def test_scan_order_and_relative_strength(spark):
    b = series(spark, [100] * 55 + [60], "STRONG").union(series(spark, [100] * 55 + [75], "MID")).union(series(spark, [100] * 55 + [95], "WEAK"))
    names = spark.createDataFrame([("WEAK", 0), ("MID", 1), ("STRONG", 2), ("GONE", 3)], "symbol string, position int")
    assert [r.symbol for r in rules.scan(b, names, "1d", "range_after_drop").collect()] == ["STRONG", "MID"]
    got = {r.symbol: r for r in rules.evaluate(b, names, "1d", "range_after_drop").collect()}
    assert got["GONE"].reason == "no data" and got["WEAK"].score == 0.0
    ten = spark.createDataFrame([(chr(65 + i), i) for i in range(10)], "symbol string, position int")
    metrics = spark.createDataFrame([(chr(65 + i), 0.1 - 0.05 * (i > 0) - 0.001 * i) for i in range(10)], "symbol string, metric double")
    assert [r.symbol for r in rules.relative_strength(ten, metrics).where("match").collect()] == ["A"]
    with pytest.raises(ValueError):
        rules.evaluate(b, names, "1d", "no_such_rule")
    with pytest.raises(ValueError):
        rules.universe(spark, "none")
    assert rules.universe(spark, "low_caps").count() == 14


def test_spread(spark):
    r = spread.ratio_bars(series(spark, [200, 201, 5]), series(spark, [100, 101])).orderBy("open_time").collect()
    assert len(r) == 2 and r[0].close == 2.0 and r[1].open == r[0].close and r[1].high == 2.0


SIGNAL = "signal_id bigint, seq bigint, symbol string, timeframe string, logged_at string, signal_type string, invalidation double, target_zone array<double>, tactical_quality string, phase string"


def signal(spark, kind, stop, target, at="1970-01-01T00:00:00Z", tf="1d"):
    return spark.createDataFrame([(1, 1, "A", tf, at, kind, stop, target, None, "C")], SIGNAL)


def trade(spark, b, s, **k):
    return backtest.backtest_signals(s, b, **k)[0].first()


def test_signal_exits(spark):
    up = series(spark, [100, 110, 115, 120, 125, 130, 135])
    assert (t := trade(spark, up, signal(spark, "long_spring", 105.0, [130.0, 140.0]))).outcome == "hit_tp" and (t.entry_price, t.exit_price) == (110.0, 130.0)
    falling = series(spark, [100, 90, 88, 84, 80])
    assert (t := trade(spark, falling, signal(spark, "long_x", 85.0, [130.0]))).outcome == "hit_sl" and t.exit_price == 85.0
    assert (t := trade(spark, falling, signal(spark, "short_utad", 96.0, [80.0, 70.0]))).outcome == "hit_tp" and t.exit_price == 80.0
    assert trade(spark, up, signal(spark, "long_x", 1.0, [999.0]), max_holding=1).outcome == "timeout"
    # as many bars as are left: the data ran out, it is no timeout
    assert trade(spark, up, signal(spark, "long_x", 1.0, [999.0]), max_holding=5).outcome == "data_exhausted"
    assert trade(spark, up, signal(spark, "long_x", 1.0, [])).outcome == "no_exit_levels"
    wide = series(spark, [100, 100, 100], highs=[100, 200, 100], lows=[100, 50, 100])
    assert trade(spark, wide, signal(spark, "long_x", 60.0, [150.0])).outcome == "hit_sl"
    assert trade(spark, up, signal(spark, "long_x", 105.0, [130.0]), fill_rule="fixed_slippage_0.1pct").entry_price == pytest.approx(110 * 1.001)


def test_skips(spark):
    s = spark.createDataFrame([(1, 1, None, "1d", "1970-01-01T00:00:00Z", "long_a", 1.0, [2.0], None, None), (2, 2, "A", "1d", None, "long_a", 1.0, [2.0], None, None), (3, 3, "A", "1d", "1970-01-01T00:00:00Z", "odd", 1.0, [2.0], None, None), (4, 4, "A", "1d", "1999-01-01T00:00:00Z", "long_a", 1.0, [2.0], None, None), (5, 5, "A", "1d", "1970-01-01T00:00:00Z", "long_a", 1.0, [2.0], None, None)], SIGNAL)
    t, k = backtest.backtest_signals(s, series(spark, [1, 1, 2]))
    assert {r.reason: r.n for r in backtest.skip_counts(s, t, k).collect()} == {"considered": 5, "executed": 1, "missing_symbol_or_timeframe": 1, "missing_timestamp": 1, "unresolvable_side": 1, "no_entry_candle": 1}


def test_breakout_rule(spark):
    b = series(spark, [100, 100, 200, 220, 250, 10, 10], opens=[100, 100, 200, 210, 240, 10, 10])
    t = backtest.backtest_rule(b, "long", 2, 1).first()
    assert (t.entry_price, t.exit_price, t.outcome) == (210.0, 250.0, "timeout")
    many = spark.createDataFrame([("A", "1d", i) for i in (2, 3, 6, 7, 8, 12)], "symbol string, timeframe string, bar_idx int")
    assert sorted(r.bar_idx for r in backtest.apart(many, 2).collect()) == [2, 6, 12]
    with pytest.raises(ValueError):
        backtest.backtest_rule(b, "long", 0, 1)


TRADE = "seq bigint, entry_time bigint, exit_time bigint, pnl_pct double, phase string"


def test_stats(spark):
    t = spark.createDataFrame([(1, 1, 0, 0.1, "A"), (2, 2, DAY, 0.2, "A"), (3, 3, DAY, 0.0, None)], TRADE)
    r = stats.trade_stats(t).first()
    assert r.total_trades == 3 and r.win_rate == pytest.approx(2 / 3) and r.sharpe == pytest.approx(0.15 / math.sqrt(0.005)) and r.max_drawdown == 0.0
    ruin = spark.createDataFrame([(1, 1, 0, 0.5, "A"), (2, 2, 0, -2.0, "A"), (3, 3, 0, 0.1, "A")], TRADE)
    assert stats.trade_stats(ruin).first().max_drawdown == pytest.approx((1.5 + 1.65) / 1.5)
    gone = spark.createDataFrame([(1, 1, 0, -1.0, "A"), (2, 2, 0, 0.5, "A")], TRADE)
    assert stats.trade_stats(gone).first().max_drawdown == pytest.approx(1.0)
    same = spark.createDataFrame([(i, i, i * DAY, 0.1, "A") for i in range(3)], TRADE)
    assert stats.trade_stats(same).first().sharpe == 0.0
    assert {(r.scope, r.key): r.total_trades for r in stats.grouped_stats(t, ["phase"]).collect()} == {("all", ""): 3, ("phase", "A"): 2}
    assert stats.trade_stats(t.where("false")).first().total_trades == 0


def test_portfolio(spark):
    ev = [(0, i, 2 * i, "open", "A", "long", 1.0, 100.0) for i in range(3)] + [(0, 0, 9, "close", None, None, None, 1500.0), (0, 0, 10, "close", None, None, None, 7.0)]
    p = ledgers.fold_positions(spark.createDataFrame(ev, "portfolio int, id int, seq int, kind string, symbol string, side string, size double, price double"))
    s = ledgers.portfolio_state(p, spark.createDataFrame([], "symbol string, mark double"), 100_000.0).first()
    assert (s.realized, s.cash, s.unrealized, s.closed_count, s.open_count) == (1400.0, 101_400.0, 0.0, 1, 2)


def test_latest_review_ties(spark):
    r = spark.createDataFrame([("a", 1, "2024-01-01", "up", True), ("a", 2, "2024-01-01", "down", False), ("a", 3, "2023-01-01", "none", False)], "analysis_id string, seq int, reviewed_at string, realized_direction string, hit_trigger boolean")
    assert ledgers.latest_reviews(r).first().review.realized_direction == "down"


def test_monthly_logs(spark, tmp_path):
    df = spark.createDataFrame([("x", "2024-01-05T00:00:00Z", 1), ("y", "2024-02-05T00:00:00Z", 2)], "symbol string, logged_at string, seq int").withColumn("month", values.month_of(F.col("logged_at")))
    ledgers.append_monthly(df, f"{tmp_path}/log")
    back = spark.read.json(f"{tmp_path}/log")
    assert [r.symbol for r in ledgers.listed(back.where("month = '2024-02'")).collect()] == ["y"]


FORECAST = "id int, direction string, trigger double, invalidation double, confidence double, analysis_mode string, decisive boolean, realized_direction string"


def test_scoring(spark):
    f = spark.createDataFrame([(1, "up", 48.0, 40.5, 0.6, "forward", True, "up"), (2, "none", None, None, 0.3, "forward", False, None), (3, "none", None, None, 0.9, "forward", True, "up"), (4, "up", 1.0, 1.0, 0.5, "retrospective", True, "not_applicable"), (5, "down", 44.0, 60.0, 0.5, "forward", True, None)], FORECAST)
    walk = spark.createDataFrame([(1, 1, 45.0, 43.0), (1, 2, 49.0, 44.5), (5, 1, 46.0, 44.0)], "id int, i int, high double, low double")
    r = {x.id: x for x in evaluation.deterministic(f, walk).collect()}
    assert (r[1].outcome, r[1].bars_to_resolution, r[1].direction, r[1].trigger) == ("hit_tp", 2, 1.0, 1.0)
    assert r[2].wait_case and r[2].direction is None
    assert (r[3].trigger, r[3].invalidation, r[3].direction) == (0.0, 1.0, 0.0)
    assert r[4].outcome is None and not r[4].wait_case
    assert r[5].used_fallback and r[5].direction == 1.0
    d = spark.createDataFrame([(1.0, 0.0, 0.0, None, None, None, 0.0, 0.0)], ", ".join(f"{n} double" for n in evaluation.WEIGHTS))
    c = evaluation.combined(d).first()
    assert c.aggregate == pytest.approx(0.2308) and c.realized_outcome is None


def test_deltas(spark):
    s = "model string, effort string, case_id string, time_mode string, anon_mode string, aggregate double, seq int"
    rows = [("m", "e", c, "blind", "anon", a, i) for i, (c, a) in enumerate([("1", 0.5), ("2", 0.4), ("2", 0.3)])] + [("m", "e", "1", "blind", "revealed", 0.9, 5), ("m", "e", "2", "blind", "revealed", 0.5, 6), ("n", "e", "1", "blind", "anon", 0.1, 7)]
    got = {r.model: (r.n, r.delta) for r in evaluation.paired_delta(spark.createDataFrame(rows, s), "leakage").collect()}
    assert got == {"m": (2, 0.3), "n": (0, None)}


def test_snapshot_space(spark):
    b = series(spark, [float(i + 1) for i in range(30)])
    cases = spark.createDataFrame([("c1", "A", 19 * DAY, 5)], "case_id string, symbol string, cutoff_ms bigint, n_bars int")
    seen, post = evaluation.snapshot(cases, b, future_bars=3)
    assert [r.open_time // DAY for r in seen.orderBy("open_time").collect()] == [0, 1, 2, 3, 4]
    assert [r.open_time // DAY for r in post.orderBy("open_time").collect()] == [4, 5, 6, 7]
    with pytest.raises(ValueError):
        evaluation.snapshot(cases, b, mode="future_visible", reveal=True)


def test_wiki(spark):
    page = "---\nsources:\n  - path: raw/book/pages/page_003.md\n---\n# H\n> one two three four five six\n> ([p. 3](x))\n\n[pp. 3-4](../raw/book/pages/page_003.md) ![i](../raw/a.png) [o](http://x) [s](#a) [[Some Page|x]]\n> **Synthesis:** skip\n> me\n"
    w = spark.createDataFrame([("wiki/a.md", page)], "path string, text string")
    inline, front = wiki.inline_citations(w), wiki.frontmatter_sources(w)
    c = inline.collect()
    assert [(r.raw_path, r.pages) for r in c] == [("raw/book/pages/page_003.md", [3, 4])]
    assert [(r.lineno, r.page) for r in front.collect()] == [(3, 3)]
    assert [r.code for r in wiki.parity(inline, front).collect()] == ["frontmatter_missing"]
    q = wiki.quote_blocks(w).collect()
    assert [(r.start, r.end, r.quote) for r in q] == [(6, 7, "one two three four five six")]
    assert wiki.quote_sources(wiki.quote_blocks(w), inline).first().raw_path == "raw/book/pages/page_003.md"
    raw = spark.createDataFrame([("raw/book/pages/page_003.md", "x One two, three four FIVE six y")], "path string, text string")
    assert wiki.found_quotes(wiki.quote_sources(wiki.quote_blocks(w), inline), raw).first().found
    assert [r.slug for r in wiki.broken_wikilinks(w).collect()] == ["some-page"]
    assert one(spark, wiki.section(F.lit("## A\nx\n## B\ny\n"), "B")) == "y\n"


def test_ingest(spark):
    assert one(spark, ingest.gate_outcome(F.lit("a\nGATE: PASS\n\n"))) == "PASS"
    assert one(spark, ingest.gate_outcome(F.lit("GATE: PASS\nGATE: PASS"))) is None
    assert one(spark, ingest.gate_outcome(F.lit("GATE: PASS\nend"))) is None
    v = spark.createDataFrame([("i", "1", ("i", "1", True)), ("i", "1", None), ("j", "1", ("i", "1", True))], "image string, version string, recorded struct<image: string, version: string, passed: boolean>")
    assert [r.reason for r in ingest.verdict(v).collect()] == ["match", "missing", "image_changed"]
    e = spark.createDataFrame([("s", 1, (None, "a", None)), ("s", 2, ("b", "c", None))], "stream string, seq int, event struct<structured_output: string, result: string, text: string>")
    assert ingest.final_outputs(e).first().output == "b"
    old = spark.createDataFrame([("l1",)], "line string")
    new = spark.createDataFrame([("l1", 1, "b", "FAIL"), ("l2", 2, "b", "PASS")], "line string, lineno int, batch string, result string")
    assert [r.result for r in ingest.new_gate_results(old, new).collect()] == ["PASS"]


def test_cards_and_reports(spark):
    from tidemark.operators import cards

    c = cards.card_fields(spark.createDataFrame([("a", "---\nsource: s: t\ntype: guess\n---\nx")], "path string, text string"))
    assert c.first().fields == {"source": "s: t", "type": "guess"}
    codes = {r.code for r in cards.card_findings(c, ["spring"], ["range"]).collect()}
    assert {"asset_missing", "type_invalid", "page_or_post_url_missing"} <= codes and "source_missing" not in codes
    assert one(spark, cards.timeframes(F.lit("Daily and 60 min, not undaily"))) == ["60-minute", "daily"]
    assert one(spark, cards.timeframe_conflicts(F.lit("intraday"), F.lit("the 5 minute chart"))) is False
    assert one(spark, cards.judge_input(F.lit("{\"a_path\": 1, \"b\": [{\"open\":1,\"high\":1,\"low\":1,\"close\":1}]}"))) == '{"b": "[REDACTED_CANDLES]"}'
    assert one(spark, cards.judge_input(F.lit("no json"))) is None
    bars = series(spark, [1, 2, 3]).withColumn("seq", F.col("open_time"))
    ok, notes = cards.chart_frame(bars, spark.createDataFrame([("A", 1.0, "x"), ("A", -1.0, "y")], "symbol string, price double, label string"), spark.createDataFrame([("A", 2, "m"), ("A", 3, "out")], "symbol string, bar_idx int, label string"))
    assert ok.count() == 3 and sorted(r.label for r in notes.collect()) == ["m", "x"]
    g = spark.createDataFrame([("m", "e", 2, 0.5, None, 0.25, 10.0, None, None, "tokens")], "model string, effort string, n bigint, mean_aggregate double, mean_expert_alignment double, mean_realized_outcome double, mean_total_tokens double, mean_cost_usd double, mean_roi double, roi_basis string")
    assert cards.report_markdown(g).endswith("| m | e | 2 | 0.5000 | N/A | 0.2500 | 10 | N/A | N/A | tokens |")


def test_html():
    page = "<html><nav>menu</nav><article><h1>T &amp; U</h1><p>a <b>b</b></p><ul><li>x</li></ul><img data-src='i.png' src='data:1' alt=' k '><script>no</script></article><p>out</p></html>"
    assert html.to_markdown(page) == "## T & U\na b\n- x\n![k](i.png)"
    assert html.to_text("<p>a</p><style>b</style> c") == "a c"
    assert html.best_image({"srcset": "a 100w, b 300w"}) == "b"
    assert html.to_markdown(None) == ""


def test_streams(spark, tmp_path):
    from tidemark.streaming import bars as st

    src_dir = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(src_dir).repartition(3).write.parquet(f"{tmp_path}/in")
    q = st.hourly_bars(st.event_stream(spark, f"{tmp_path}/in"), "60 days").writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = src.hourly_bars(spark.read.parquet(src_dir))
    assert sorted(map(tuple, spark.table("bars_out").select("symbol", "open_time", "open", "close").collect())) == sorted(map(tuple, batch.select("symbol", "open_time", "open", "close").collect()))
    w = st.latest_reviews(st.event_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/latest", f"{tmp_path}/cp").start()
    w.awaitTermination(120)
    assert st.read_latest(spark, f"{tmp_path}/latest").count() == spark.read.parquet(src_dir).select("user_id").distinct().count()
    o = st.open_signals(st.event_stream(spark, f"{tmp_path}/in"), 0.5, 1.5).writeStream.format("memory").queryName("open_out").outputMode("append").trigger(availableNow=True).start()
    o.awaitTermination(120)
    assert spark.table("open_out").count() == spark.table("open_out").select("user_id").distinct().count() > 0


def test_chart_timeframes_in_one_spelling(spark):
    want = {"4 hr": "4-hour", "4-hour point & figure": "4-hour", "015min": "15-minute", "2 day": "2-day", "Weekly  P&F": "weekly", "pnf": None, "some text": None, "1234 min": None, "daily chart": None}
    df = spark.createDataFrame([(x,) for x in want], "x string")
    assert {r.x: r.y for r in df.select("x", values.chart_timeframe(F.col("x")).alias("y")).collect()} == want


def test_general_numbers(spark):
    numbers = [100.0, 98.0, 0.5, 12345.6, 9999.6, 1234.6, 0.00012346, 0.000012346, 1.0, 0.1234567, 123.45]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert {r.x: r.y for r in df.select("x", values.general(F.col("x")).alias("y")).collect()} == {x: f"{x:.4g}" for x in numbers}


def test_range_without_a_midpoint_is_unfit(spark):
    got = rules.range_duration(series(spark, [0] * 28), "1d").first()
    assert not got.match and got.reason.startswith("insufficient data")
    assert "of midpoint 100 (max dev" in rules.range_duration(series(spark, [98 + i % 5 for i in range(28)]), "1d").first().reason


def test_judge_input_keeps_the_rest(spark):
    import json

    bar = {"open": 1, "high": 2, "low": 0, "close": 1}
    given = {"ok": [[bar, bar], [bar, 1], []], "one": bar, "symbol": "X", "p": "data/eval/x", "deep": {"chart": 1, "note": "[REDACTED_CANDLE]", "n": [None, True, "case_7/x"]}}
    want = {"ok": ["[REDACTED_CANDLES]", ["[REDACTED_CANDLE]", 1], []], "one": "[REDACTED_CANDLE]", "p": "[REDACTED_PATH]", "deep": {"note": "[REDACTED_CANDLE]", "n": [None, True, "[REDACTED_PATH]"]}}
    assert json.loads(spark.range(1).select(cards.judge_input(F.lit(json.dumps(given)))).first()[0]) == want
    assert spark.range(1).select(cards.judge_input(F.lit('"chart.png"'))).first()[0] == '"[REDACTED_PATH]"'


def test_best_image_order():
    assert html.best_image({"src": "data:image/png", "data-original": "b.jpg", "srcset": "c 1w"}) == "b.jpg"
    assert html.best_image({"srcset": "s.jpg 2x, m.jpg 640w , l.jpg 1280w"}) == "l.jpg"
    assert html.best_image({"data-srcset": "only.jpg"}) == "only.jpg" and html.best_image({"src": "data:x"}) is None


def test_short_passages_and_quotes_count(spark):
    passages = spark.createDataFrame([("a", "Two words"), ("b", "one two three four five six seven"), ("c", "!!"), ("d", "six")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "has two  WORDS here"), (2, "one two three four five six seven eight"), (3, None), (4, "one two three four five six nine")], "doc_id bigint, text string")
    for most in (100_000, 0):
        wiki.FEW_PASSAGES = most
        assert {tuple(r) for r in wiki.passages_in(passages, docs).collect()} == {("a", 1), ("b", 2), ("d", 2), ("d", 4)}
    wiki.FEW_PASSAGES = 100_000
