"""Streams whose events come late and in pieces, against the same events in order."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import bars as st

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
T0 = datetime(2024, 1, 1)


def put(spark, folder, batches):
    """A file for each batch, read in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, T0 + timedelta(minutes=m), u, "x", float(v), "") for i, m, u, v in rows], EVENT).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.startswith("part") and os.path.getmtime(f"{folder}/{name}") > 1e9:
                os.utime(f"{folder}/{name}", (k + 1, k + 1))


def ran(query, name, tmp_path):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def closed(ticks, stop, target):
    """Each user's closing tick, by event order."""
    found, entry = {}, {}
    for m, i, u, v in sorted((m, i, u, v) for i, m, u, v in ticks):
        if u not in entry:
            entry[u] = v
        elif u not in found and (v <= entry[u] * stop or v >= entry[u] * target):
            found[u] = (i, "hit_sl" if v <= entry[u] * stop else "hit_tp")
    return found


def test_late_and_split_ticks_resolve_in_event_order(spark, tmp_path):
    r = random.Random(2)
    ticks = [(i, i * 3 + r.randrange(3), r.randrange(6), 100 + r.choice((-30, -5, 0, 5, 30))) for i in range(120)]
    moved = sorted(ticks, key=lambda t: t[1] + r.randrange(-50, 50))  # up to 100 minutes out of order
    batches = [moved[k : k + 30] for k in range(0, 120, 30)] + [[(999, 5000, 99, 1.0)]]
    put(spark, f"{tmp_path}/in", batches)
    ran(st.open_signals(st.event_stream(spark, f"{tmp_path}/in", 1), 0.8, 1.2, late="2 hours"), "late_out", tmp_path)
    got = {x.user_id: (x.event_id, x.outcome) for x in spark.table("late_out").collect()}
    assert got == closed(ticks, 0.8, 1.2) and len(got) >= 5
    by_arrival = {}
    for k, batch in enumerate(batches[:-1]):
        for i, m, u, v in batch:
            by_arrival.setdefault(u, []).append((i, k * 1000 + m % 7, u, v))
    assert closed([t for ts in by_arrival.values() for t in ts], 0.8, 1.2) != got  # the order of coming would say otherwise


def test_quiet_users_are_forgotten(spark, tmp_path):
    day = 1440
    put(spark, f"{tmp_path}/in", [[(k, k, k, 100) for k in range(40)], [(100, 2 * day, 99, 1.0)], [(101, 9 * day, 98, 1.0)], [(102, 9 * day + 1, 3, 200.0)], [(103, 20 * day, 97, 1.0)], [(104, 21 * day, 97, 1.0)]])
    q = ran(st.open_signals(st.event_stream(spark, f"{tmp_path}/in", 1), 0.5, 1.5, late="1 minute", keep_ms=3 * day * 60_000), "quiet_out", tmp_path)
    # user 3 came back a week later at twice the price: a new position, not a target
    assert spark.table("quiet_out").count() == 0
    sizes = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(sizes) >= 40 and sizes[-1] < 10


def test_latest_reviews_touch_only_what_came(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, r.randrange(1000), r.randrange(15), 1.0) for i in range(200)]
    put(spark, f"{tmp_path}/in", [rows[k : k + 20] for k in range(0, 200, 20)])
    q = st.latest_reviews(st.event_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/latest", f"{tmp_path}/cp", fold_every=4).start()
    q.awaitTermination(300)
    want = {}
    for i, m, u, _ in rows:
        want[u] = max(want.get(u, (0, 0)), (m, i))
    got = {x.user_id: (int((x.ts - T0).total_seconds() // 60), x.event_id) for x in st.read_latest(spark, f"{tmp_path}/latest").collect()}
    assert got == want
    changed, folded = ({int(p.name.split("=")[1]) for p in (tmp_path / "latest" / kind).iterdir()} for kind in ("changed", "folded"))
    assert folded == {7} and changed == {8, 9}
    touched = spark.read.parquet(f"{tmp_path}/latest/changed/batch=9")
    assert {x.user_id for x in touched.collect()} == {u for _, _, u, _ in rows[180:]}
    # a part that was not written whole counts for nothing
    (tmp_path / "latest" / "changed" / "batch=50").mkdir()
    assert st.read_latest(spark, f"{tmp_path}/latest").where(F.col("event_id") < 0).count() == 0 and st.read_latest(spark, f"{tmp_path}/latest").count() == len(want)


@pytest.fixture(autouse=True)
def one_shuffle(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
