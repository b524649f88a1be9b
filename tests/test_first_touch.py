"""Trades by blocks of bars, and the next bar by stretches of time, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest
from tidemark.sources import bars as src

BAR = "symbol string, timeframe string, open_time bigint, open double, high double, low double, close double"
TRADE = "symbol string, timeframe string, trade_id bigint, side string, entry_idx int, stop double, target double"


def walks(r, lengths):
    rows = []
    for name, n in lengths.items():
        price, at = 100.0, 0
        for _ in range(n):
            new = max(1.0, price + r.choice((-2, -1, 0, 1, 2)))
            rows.append((name, "1h", at, price, max(price, new) + r.choice((0, 1)), min(price, new) - r.choice((0, 1)), new))
            price, at = new, at + r.choice((1, 1, 5)) * 3_600_000
    return rows


def resolved(trade, series, holding):
    _, _, _, side, entry, stop, target = trade
    last = min(entry + holding, len(series) - 1) if holding is not None else len(series) - 1
    cut = holding is not None and entry + holding < len(series) - 1
    if stop is None or target is None:
        return last, series[last][6], "no_exit_levels"
    for i in range(entry, last + 1):
        high, low = series[i][4], series[i][5]
        if low <= stop if side == "long" else high >= stop:
            return i, stop, "hit_sl"
        if high >= target if side == "long" else low <= target:
            return i, target, "hit_tp"
    return last, series[last][6], "timeout" if cut else "data_exhausted"


@pytest.mark.parametrize(("fan", "holding"), [(2, None), (3, 7), (64, 40), (5, None)])
def test_exits_equal_a_walk_over_all_bars(spark, monkeypatch, fan, holding):
    monkeypatch.setattr(backtest, "FAN", fan)
    r = random.Random(fan)
    rows = walks(r, {"A": 150, "B": 1, "C": 37})
    series = {s: [x for x in rows if x[0] == s] for s in "ABC"}
    trades = []
    for k in range(300):
        s = r.choice("AAABCC")
        entry, long = r.randrange(len(series[s])), r.random() < 0.5
        near, far = sorted(r.choice((1, 3, 8, 20, 500)) for _ in range(2))
        price = series[s][entry][3]
        stop, target = (price - near, price + far) if long else (price + near, price - far)
        trades.append((s, "1h", k % 290, "long" if long else "short", entry, None if k % 17 == 0 else stop, None if k % 23 == 0 else target))
    indexed = src.with_index(spark.createDataFrame(rows, BAR))
    got = backtest.resolve(spark.createDataFrame(trades, TRADE), indexed, holding)
    found = sorted((x.trade_id, x.symbol, x.entry_idx, str(x.stop), x.exit_idx, x.exit_price, x.outcome) for x in got.collect())
    want = sorted((t[2], t[0], t[4], str(t[5]), *resolved(t, series[t[0]], holding)) for t in trades)
    assert found == want
    assert {w[-1] for w in want} >= {"hit_sl", "hit_tp", "no_exit_levels", "data_exhausted"}


def test_a_trade_meets_no_row_a_bar(spark):
    """All joins of the plan are by key and bring one block, or the bar of the exit."""
    b = src.with_index(spark.createDataFrame(walks(random.Random(1), {"A": 400}), BAR))
    t = spark.createDataFrame([("A", "1h", k, "long", k, -1e9, 1e9) for k in range(300)], TRADE)
    out = backtest.resolve(t, b, None)
    levels = backtest.bar_blocks(b)
    assert len(levels) == 2 and levels[0].count() == 7 and levels[1].count() == 1
    assert out.count() == 300
    assert "Cartesian" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "BroadcastNestedLoop" not in plan


def test_next_bar_equals_a_search(spark, monkeypatch):
    r = random.Random(4)
    rows = walks(r, {"A": 200, "B": 3})
    for stretch in (3_600_000, 40_000_000, 10**12):
        monkeypatch.setattr(backtest, "STRETCH_MS", stretch)
        top = max(x[2] for x in rows)
        signals = [(k, r.choice("ABZ"), "1h", r.choice((r.randrange(-10**7, top + 10**7), r.choice(rows)[2]))) for k in range(200)]
        s = spark.createDataFrame(signals, "id bigint, symbol string, timeframe string, time_ms bigint")
        got = {x.id: x.open for x in backtest.next_bars(s, spark.createDataFrame(rows, BAR)).select("id", F.col("bar.open_time").alias("open")).collect()}
        assert got == {k: min((x[2] for x in rows if x[0] == name and x[2] > t), default=None) for k, name, _, t in signals}


SIGNAL = "signal_id bigint, seq bigint, symbol string, timeframe string, logged_at string, signal_type string, invalidation double, target_zone array<double>"


def test_backtests_of_a_range_and_a_choice(spark):
    rows = [("A", "1d", i * 86_400_000, 100.0 + i, 101.0 + i, 99.0 + i, 101.0 + i) for i in range(20)] + [("B", "1d", i * 86_400_000, 50.0, 50.0, 50.0, 50.0) for i in range(20)]
    b = spark.createDataFrame(rows, BAR)
    signals = [(k, k, "AB"[k % 2], "1d", f"1970-01-{k + 1:02d}T00:00:00+02:00", ("long_x", "short_y")[k % 3 == 0], 1.0, [500.0]) for k in range(12)] + [(99, 99, "A", "1d", "soon", "long_x", 1.0, [2.0])]
    s = spark.createDataFrame(signals, SIGNAL)
    ids = lambda **k: sorted(x.signal_id for part in backtest.backtest_signals(s, b, **k) for x in part.select("signal_id").collect())
    assert ids() == [*range(12), 99]
    assert ids(symbol="A") == [0, 2, 4, 6, 8, 10, 99] and ids(signal_type="short_y") == [0, 3, 6, 9]
    # 02:00 east of Greenwich is the evening before; both ends count
    assert ids(start="1970-01-03T22:00:00Z", end="1970-01-05T22:00:00Z") == [3, 4, 5]
    trades, skipped = backtest.backtest_signals(s, b, candle_limit=5, symbol="A")
    assert {x.signal_id: x.entry_time // 86_400_000 for x in trades.collect()} == dict.fromkeys((0, 2, 4, 6, 8, 10), 15) and skipped.count() == 1
    for wrong in ({"fill_rule": "best"}, {"max_holding": 0}):
        with pytest.raises(ValueError):
            backtest.backtest_signals(s, b, **wrong)
    rising = lambda **k: [(x.symbol, x.entry_time // 86_400_000) for x in backtest.backtest_rule(b, "long", 2, 3, **k).orderBy("entry_time").collect()]
    assert rising(symbols=["B"]) == [] and rising(timeframe="4h") == [] and rising(symbols=["A", "B"]) == rising()
    assert rising()[:2] == [("A", 3), ("A", 8)]
    assert rising(candle_limit=6)[0] == ("A", 17) and rising(start="1970-01-11T00:00:00Z", end="1970-01-15")[0] == ("A", 13)
    with pytest.raises(ValueError):
        backtest.backtest_rule(b, "both", 2, 3)
