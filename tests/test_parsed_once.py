"""Texts of cards and verdicts are taken apart once, however many fields are asked for."""

from __future__ import annotations

from tidemark.operators import cards, review


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_card_fields_are_made_once(spark):
    files = spark.createDataFrame([("a", "---\nasset: x\nasset: y: z\ntype : t\npage:\n---\n"), ("b", "---\nphase: A\ntype: forward\n---\n"), ("c", "none"), ("d", None)], "path string, text string")
    fields = cards.card_fields(files)
    assert {r["path"]: r["fields"] for r in fields.collect()} == {"a": {"asset": "y: z", "page": ""}, "b": {"phase": "A", "type": "forward"}, "c": {}, "d": None}
    assert plan(cards.card_findings(fields, ["spring"], ["range"])).count("regexp_extract(") == 1


def test_verdicts_are_parsed_once(spark):
    got = review.recorded_verdicts(spark.createDataFrame([("a", "{}"), ("b", None)], "file string, text string"))
    shown = plan(got.where("verdict IS NOT NULL").select("file", "verdict.passed", "verdict.canary", "verdict.detail"))
    assert {r["file"] for r in got.collect()} == {"a", "b"}
    assert shown.count("from_json(") == 2
