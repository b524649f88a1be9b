"""Logs in many pieces and over month ends: numbered lines, months in UTC, and the tools that write and read them."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import logs, records

from test_records import ANALYSIS, REVIEW, SIGNAL, written


@pytest.fixture
def small_pieces(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_over_the_pieces_of_a_file(spark, tmp_path, small_pieces):
    r = random.Random(1)
    months = {m: [SIGNAL % (f"{m}/{k + 1}", f"{m}-05T00:00:00Z") + " " * r.randrange(300) if r.random() < 0.8 else "" for k in range(n)] for m, n in (("2024-01", 40), ("2024-02", 1), ("2024-03", 90))}
    at = written(tmp_path / "s", months)
    got = records.read_signals(spark, at, "signal_id string, logged_at string")
    assert got.rdd.getNumPartitions() > 0 and spark.read.text(at).rdd.getNumPartitions() > 20
    rows = got.select("signal_id", F.concat("month", F.lit("/"), "line").alias("n")).collect()
    assert len(rows) == sum(1 for m in months.values() for x in m if x) and all(x.signal_id == x.n for x in rows)


def test_a_broken_line_is_named_by_its_file_and_number(spark, tmp_path, small_pieces):
    good = [ANALYSIS % (str(k), "2024-01-05T00:00:00Z") for k in range(60)]
    for n, bad in ((1, "{oops"), (37, "[1]"), (61, '{"type": "odd"}')):
        lines = [*good[: n - 1], bad, *good[n - 1 :]]
        analyses, _ = records.read_journal(spark, written(tmp_path / f"b{n}", {"2024-01": ["", *lines]}), "analysis_id string", "reviewed_at string")
        with pytest.raises(Exception, match=rf"part-0\.json:{n + 1}: "):
            analyses.collect()


@pytest.mark.parametrize("flat", [False, True])
def test_months_are_those_of_utc(spark, tmp_path, flat):
    """A signal of January in UTC lies in a range that begins on 1 February east of Greenwich."""
    months = {"2024-01": [SIGNAL % ("late", "2024-01-31T23:00:00Z"), SIGNAL % ("early", "2024-01-31T22:00:00Z")], "2024-02": [SIGNAL % ("next", "2024-02-01T00:00:00Z")], "2024-03": [SIGNAL % ("west", "2024-03-01T03:00:00Z"), SIGNAL % ("out", "2024-03-01T06:00:00Z")]}
    if flat:
        for m, lines in months.items():
            (tmp_path / f"{m}.jsonl").write_text("\n".join(lines))
        (tmp_path / "notes.txt").write_text("{}")
        at = str(tmp_path)
    else:
        at = written(tmp_path / "s", months)
    ids = lambda *b: sorted(x.signal_id for x in records.read_signals(spark, at, "signal_id string, logged_at string", *b).collect())
    assert ids("2024-02-01T00:30:00+02:00", "2024-02-29T23:00:00-05:00") == ["late", "next", "west"]
    assert ids("2024-02-01T00:30:00+02:00") == ["late", "next", "out", "west"] and ids("2024-02-01", "2024-02-01") == ["next"]
    assert ids("2025-01-01", "2025-02-01") == [] and len(ids()) == 5
    assert records.months_between("2023-11-30T23:30:00-01:00", "2024-02-01T00:00:00") == ["2023-12", "2024-01", "2024-02"]
    with pytest.raises(ValueError):
        records.months_between("soon", "later")


def signals(spark, rows):
    return spark.createDataFrame([(s, "1h", kind, [1.0, 2.0], 0.5, zone, at) for s, kind, zone, at in rows], "symbol string, timeframe string, signal_type string, entry_zone array<double>, invalidation double, target_zone array<double>, logged_at string")


def test_signal_log(spark, tmp_path):
    log = logs.SignalLog(spark, str(tmp_path / "log"))
    log.append(signals(spark, [("btc", "long_spring", [3.0, 4.0], "2024-01-31T23:30:00-01:00"), ("eth/usdt", "short_utad", [0.1, 0.2], "2024-01-02T00:00:00")]))
    log.append(signals(spark, [("BTCUSDT", "long_sos", [5.0, 6.0], None)]))
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("month"))[:2] == ["month=2024-01", "month=2024-02"]
    listed = log.list().collect()
    assert [(x.symbol, x.signal_type) for x in listed] == [("ETHUSDT", "short_utad"), ("BTCUSDT", "long_spring"), ("BTCUSDT", "long_sos")]
    assert listed[1].logged_at == "2024-02-01T00:30:00.000000Z" and listed[1].target_zone == [3.0, 4.0] and listed[1].evidence is None
    assert datetime.now(UTC) - datetime.fromisoformat(listed[2].logged_at) < timedelta(hours=1)
    assert [x.signal_type for x in log.list("BTCUSDT", start="2024-02-01", end="2024-02-02").collect()] == ["long_spring"]
    one = log.get(listed[0].signal_id).collect()
    assert [x.symbol for x in one] == ["ETHUSDT"] and log.get("none").count() == 0
    for bad in (("b!", "long_x", [1.0, 2.0], None), ("BTC", "odd", [1.0, 2.0], None), ("BTC", "long_x", [1.0], None), ("BTC", "long_x", [1.0, 2.0], "soon")):
        with pytest.raises(ValueError, match="rule"):
            log.append(signals(spark, [("BTC", "long_ok", [1.0, 2.0], None), bad]))
    assert log.list().count() == 3


def analysis(spark, rows):
    texts = "timeframe model effort narrative structure phase".split()
    return spark.createDataFrame([(i, s, at, *(f" {t} " for t in texts), ("up", " t ", "i", 0.4)) for i, s, at in rows], "analysis_id string, symbol string, logged_at string, " + ", ".join(f"{t} string" for t in texts) + ", forecast struct<direction:string, trigger:string, invalidation:string, confidence:double>")


def test_journal_log(spark, tmp_path):
    log = logs.JournalLog(spark, str(tmp_path / "log"))
    log.append(analysis(spark, [("a", "BTC", "2024-01-31T23:30:00-01:00"), ("b", "ETH", "2024-03-05T00:00:00Z")]))
    log.append(analysis(spark, [("c", "BTC", "2024-03-06T00:00:00Z")]))
    say = lambda rows: spark.createDataFrame(rows, "analysis_id string, realized_direction string, hit_trigger boolean, note string, reviewed_at string")
    assert log.review(say([("a", "up", True, "n", "2024-05-01T00:00:00Z"), ("z", "up", True, "n", None)])) == 1
    # later by the clock, though its text sorts first; then an equal time, which counts as it is written last
    assert log.review(say([("a", "down", False, "late", "2024-04-30T23:30:00-05:00")])) == 1
    assert log.review(say([("b", "x", False, "first", "2024-05-01T00:00:00Z")])) == 1
    got = {x.analysis_id: x for x in log.list().collect()}
    assert [x.analysis_id for x in log.list().collect()] == ["a", "b", "c"]
    assert got["a"].review.note == "late" and got["a"].model == "model" and got["a"].forecast.trigger == "t" and got["b"].review.hit_trigger is False and got["c"].review is None
    assert [x.analysis_id for x in log.list(symbol="BTC", start="2024-02-01", end="2024-02-28").collect()] == ["a"]
    assert log.get("a").first().review.note == "late" and log.get("q").count() == 0
    with pytest.raises(ValueError, match="forecast"):
        log.append(analysis(spark, [("d", "BTC", None)]).withColumn("forecast", F.struct(F.lit(" ").alias("direction"), F.lit("t").alias("trigger"), F.lit("i").alias("invalidation"), F.lit(0.1).alias("confidence"))))
    with pytest.raises(ValueError, match="note"):
        log.review(say([("a", "up", True, " ", None)]))
    assert log.list().count() == 3
    raw = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "log")).collect()]
    assert all("review" in x for x in raw) and sum(x.get("type") == "review" for x in raw) == 3
    (tmp_path / "log" / "month=2024-03" / "broken.txt").write_text(REVIEW % "a" + "\n{bad\n")
    with pytest.raises(Exception, match=r"broken\.txt:2: "):
        log.list().collect()
