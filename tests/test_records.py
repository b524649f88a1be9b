"""Logs are read by month, loosely for signals and strictly for journals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import records

SIGNAL = '{"signal_id": "%s", "symbol": "BTC", "logged_at": "%s"}'
ANALYSIS = '{"analysis_id": "%s", "logged_at": "%s", "symbol": "s", "timeframe": "t", "model": "m", "effort": "e", "narrative": "n", "structure": "s", "phase": "C", "forecast": {}, "review": null}'
REVIEW = '{"analysis_id": "%s", "type": "review", "review": {"reviewed_at": "2024-03-01T00:00:00Z", "realized_direction": "up", "hit_trigger": true, "note": ""}}'


def written(folder, months):
    for month, lines in months.items():
        (folder / f"month={month}").mkdir(parents=True)
        (folder / f"month={month}" / "part-0.json").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_signals_pass_over_broken_lines(spark, tmp_path):
    at = written(tmp_path / "s", {"2024-01": [SIGNAL % ("a", "2024-01-05T00:00:00Z"), "", "{broken", '{"signal_id": "b"}'], "2024-02": [SIGNAL % ("c", "2024-02-05T00:00:00Z"), SIGNAL % ("d", "soon"), SIGNAL % ("e", "2024-02-20T00:00:00Z")]})
    schema = "signal_id string, symbol string, logged_at string"
    assert {r.signal_id for r in records.read_signals(spark, at, schema).collect()} == {"a", "c", "e"}
    some = records.read_signals(spark, at, schema, "2024-02-01T00:00:00Z", "2024-02-05T00:00:00Z")
    assert [r.signal_id for r in some.collect()] == ["c"]
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan or "PartitionFilters: [(month" in plan or "month" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_journal_keeps_reviews_of_all_months_and_stops_on_a_broken_line(spark, tmp_path):
    months = {"2024-01": [ANALYSIS % ("a", "2024-01-05T00:00:00Z")], "2024-02": [ANALYSIS % ("b", "2024-02-05T00:00:00Z"), ""], "2024-03": [REVIEW % "b"]}
    schemas = "analysis_id string, logged_at string", "reviewed_at string, hit_trigger boolean"
    analyses, reviews = records.read_journal(spark, written(tmp_path / "j", months), *schemas, "2024-02-01T00:00:00Z", "2024-02-28T00:00:00Z")
    assert [r.analysis_id for r in analyses.collect()] == ["b"]
    assert [(r.analysis_id, r.hit_trigger) for r in reviews.collect()] == [("b", True)]
    for k, bad in enumerate(["{oops", '{"analysis_id": "x"}', '{"type": "odd"}', "[1]", (ANALYSIS % ("a", "soon"))]):
        broken, _ = records.read_journal(spark, written(tmp_path / f"b{k}", {"2024-01": [bad]}), *schemas)
        with pytest.raises(Exception, match="part-0.json"):
            broken.collect()


def test_dimension_out_of_range_stops(spark):
    df = spark.createDataFrame([(1.2,)], "x double")
    with pytest.raises(Exception, match="between 0 and 1"):
        df.select(records.dimension(F.col("x"), "judge").alias("d")).collect()


def test_positions_of_an_unknown_status(spark):
    with pytest.raises(ValueError, match="status"):
        records.positions_of(spark.range(1), "shut")
