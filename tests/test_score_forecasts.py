"""Every usable signal is scored, against plain Python over a small table."""

from __future__ import annotations

import collections
import datetime

from tidemark.plans import evaluation


def test_every_usable_signal_is_scored(spark, tmp_path):
    began = datetime.datetime(2024, 1, 1)
    rows = [(i, "click", float(100 + i % 7), began + datetime.timedelta(minutes=3 * i)) for i in range(400)]
    rows[33] = (33, "click", 900.0, rows[33][3])  # resolves some
    spark.createDataFrame(rows, "event_id bigint, event_type string, value double, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: r for r in evaluation.b05_score_forecasts(spark, str(tmp_path)).collect()}
    bars = collections.defaultdict(list)
    for _, _, v, t in rows:
        bars[t.replace(minute=0)].append(v)
    opens = sorted(bars)
    signals = [r for r in rows if any(o > r[3] for o in opens)]
    assert sorted(got) == [r[0] for r in signals] and len(got) > 30
    for i, _, v, t in signals:
        long, walk = i % 2 == 0, [o for o in opens if o > t][:10]
        said = "none" if i % 35 == 0 else "up" if long else "down"
        stop, aim = (v * 0.5, v * 1.5) if long else (v * 1.5, v * 0.5)
        want = ("open", None)
        for k, o in enumerate(walk, 1):
            low, high = min(bars[o]), max(bars[o])
            lost, won = (low <= stop, high >= aim) if said == "up" else (high >= stop, low <= aim)
            if said != "none" and (lost or won):
                want = ("hit_sl" if lost else "hit_tp", k)
                break
        decisive = None if i % 25 == 0 else i % 20 != 0
        wait = decisive is False and said == "none" and (i % 100) / 100 <= 0.35
        if i % 45 == 0 or wait:
            want = (None, None)
        assert (got[i].outcome, got[i].bars_to_resolution) == want, i
