"""A client asked for one symbol at a time: bars, errors, and which symbols are asked for at all."""

from __future__ import annotations

import json

import pytest

from tidemark.sources import fetched

CLIENT = "tidemark.sources.fetched:SavedRows"
DAY = 86_400_000


@pytest.fixture
def saved(tmp_path):
    def put(symbol, rows):
        (tmp_path / f"symbol={symbol}").mkdir()
        (tmp_path / f"symbol={symbol}" / "part-0.txt").write_text("\n".join(json.dumps(r) for r in rows))

    bar = lambda i, p: [i * DAY, str(p), str(p + 1), str(p - 1), str(p), "10", (i + 1) * DAY - 1, "1000", 7]
    put("FALL", [bar(i, 200 - i) for i in range(80)])
    put("FLAT", [bar(i, 100) for i in range(80)])
    put("FEW", [bar(i, 100) for i in range(3)])
    put("BROKEN", [bar(0, 1), [1, 2]])
    put("ODD%20ONE", [bar(0, 5)])
    return str(tmp_path)


def test_errors_stand_beside_bars(spark, saved):
    names = ["FALL", "GONE", "BROKEN", "FLAT", "ODD ONE", "FALL"]
    df = fetched.fetched_bars(spark, names, "1D ", 60, CLIENT, folder=saved)
    assert df.rdd.getNumPartitions() == 5
    rows = df.collect()
    errors = {r.symbol: r.error for r in rows if r.error}
    assert errors == {"GONE": "LookupError: unknown symbol GONE", "BROKEN": "ValueError: a row of 2 fields"}
    bars = [r for r in rows if r.error is None]
    assert {s: sum(r.symbol == s for r in bars) for s in set(names)} == {"FALL": 60, "FLAT": 60, "ODD ONE": 1, "GONE": 0, "BROKEN": 0}
    first = min((r for r in bars if r.symbol == "FALL"), key=lambda r: r.open_time)
    assert (first.open_time, first.timeframe, first.high, first.trades, first.close_time) == (20 * DAY, "1d", 181.0, 7, 21 * DAY - 1)


def test_filters_choose_what_is_fetched(spark, saved):
    df = fetched.fetched_bars(spark, ["FALL", "GONE", "FLAT"], "1d", 60, CLIENT, folder=saved)
    one = df.where("symbol = 'FLAT'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 60
    assert df.where("symbol in ('GONE', 'FLAT') and error is not null").count() == 1
    assert df.where("symbol = 'NONE'").count() == 0 and df.where("close < 130").where("symbol = 'FALL'").count() == 9


def test_scan_says_which_symbols_failed(spark, saved):
    got = {r.symbol: r for r in fetched.scan_fetched(spark, ["FALL", "GONE", "FLAT", "FEW"], "1d", "range_after_drop", CLIENT, folder=saved).collect()}
    assert got["FALL"].match and got["FALL"].score > 0.2 and not got["FLAT"].match
    assert got["GONE"].reason == "data fetch failed: LookupError: unknown symbol GONE" and (got["GONE"].match, got["GONE"].score) == (False, 0.0)
    assert got["FEW"].reason.startswith("insufficient data") and [got[s].position for s in ("FALL", "GONE", "FLAT", "FEW")] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="reference"):
        fetched.scan_fetched(spark, ["FALL"], "1d", "relative_strength_top_decile", CLIENT, reference="GONE", folder=saved)
    strong = {r.symbol: r for r in fetched.scan_fetched(spark, ["FALL", "GONE"], "1d", "relative_strength_top_decile", CLIENT, reference="FLAT", folder=saved).collect()}
    assert strong["FALL"].score < 0 and strong["GONE"].reason.startswith("data fetch failed")
    for wrong in ({"symbols": []}, {"rule": "none"}, {"timeframe": "7x"}):
        with pytest.raises(ValueError):
            fetched.scan_fetched(spark, **({"symbols": ["FALL"], "timeframe": "1d", "rule": "range_after_drop", "client": CLIENT, "folder": saved} | wrong))
