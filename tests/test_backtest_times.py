"""Signals at the bounds of milliseconds, and statistics whose equity runs far, against the SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.operators import stats
from tidemark.plans import evaluation, market


def events(folder, ts, values, kinds=None):
    n = len(ts)
    table = pa.table({"event_id": pa.array(range(1, n + 1), pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array([1] * n, pa.int64()), "event_type": kinds or ["view"] * n, "value": pa.array(values, pa.float64()), "props": ["{}"] * n})
    pq.write_table(table, f"{folder}/events.parquet")
    return f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{folder}/events.parquet'"


def both(spark, folder, view, module, name):
    con = duckdb.connect()
    con.execute(view)
    df = module.QUERIES[name](spark, str(folder))
    rel = con.execute(module.SQL[name])
    names = [c[0] for c in rel.description]
    key = lambda r: tuple(str(x) for x in r)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=key), sorted(rel.fetchall(), key=key)


@pytest.mark.parametrize(("module", "name"), [(market, "j03_next_bar"), (market, "b01_backtest_signals"), (market, "a05_skip_reasons"), (evaluation, "b05_score_forecasts")], ids=lambda x: x if isinstance(x, str) else "")
def test_signals_at_the_end_of_an_hour(spark, tmp_path, module, name):
    """The SQL rounds a signal's time to milliseconds: the last half of one belongs to the next hour."""
    top = datetime(2024, 1, 1)
    ends = [timedelta(microseconds=-u) for u in (1, 499, 500, 501, 999, 1000)]
    ts = [top + timedelta(hours=h) + e for h in range(1, 7) for e in (timedelta(minutes=9), ends[h - 1])]
    got, want = both(spark, tmp_path, events(tmp_path, ts, [10.0 + i for i in range(len(ts))]), module, name)
    assert got == want


def test_equity_beyond_the_range_of_doubles(spark):
    """Equity that falls below the least double stays 0, as in the SQL's fold."""
    for returns, want in (([-0.5] * 1200 + [1.0] * 1300 + [-3.0], 1.0), ([0.1, -2.5, 0.3, -0.4], 2.95)):
        rows = [("k", i, i, r) for i, r in enumerate(returns)]
        got = stats.drawdown(spark.createDataFrame(rows, "k string, entry_time long, seq long, pnl_pct double"), ["k"]).first()["max_drawdown"]
        fold = duckdb.connect().execute(f"SELECT list_reduce(list_prepend({{'e': 1.0::DOUBLE, 'p': 1.0::DOUBLE, 'd': 0.0::DOUBLE}}, list_transform({returns}::DOUBLE[], lambda r: {{'e': 1 + r, 'p': 0.0::DOUBLE, 'd': 0.0::DOUBLE}})), lambda a, x: {{'e': a.e * x.e, 'p': greatest(a.p, a.e * x.e), 'd': greatest(a.d, (greatest(a.p, a.e * x.e) - a.e * x.e) / greatest(a.p, a.e * x.e))}}).d").fetchall()[0][0]
        assert got == fold
        assert got == pytest.approx(want)
