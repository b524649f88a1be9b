"""Answer keys, trees, portfolios, verdicts and link repairs on small written cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import review


def keys(spark, *texts):
    return review.answers(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string"))


def test_answer_keys_of_three_shapes(spark):
    got = {(r.file, r.case_id): r.answer for r in keys(spark, '{"a": {"x": 1}}', '{"cases": [{"case_id": "a", "x": 1}, {"case_id": "a", "x": 2}]}', ' [{"case_id": 7}]', "{}").collect()}
    assert got == {("0", "a"): {"x": "1"}, ("1", "a"): {"x": "2"}, ("2", "7"): {}}


@pytest.mark.parametrize(("text", "why"), [("3", "unsupported"), ('[{"x": 1}]', "lacks case_id"), ("[5]", "must be an object")])
def test_broken_answer_keys_stop_the_reading(spark, text, why):
    with pytest.raises(Exception, match=why):
        keys(spark, text).collect()


def test_markdown_tree_leaves_health_out(spark, tmp_path):
    for at in ("index.md", "a/b.md", "health/r.md", "a/n.txt"):
        (tmp_path / "wiki" / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "wiki" / at).write_text("one\ntwo")
    assert sorted(map(tuple, review.read_markdown(spark, str(tmp_path / "wiki")).collect())) == [("a/b.md", "one\ntwo"), ("index.md", "one\ntwo")]


def test_portfolio_file(spark, tmp_path):
    at = tmp_path / "p.json"
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        review.read_portfolio(spark, str(at), "cash double").collect()
    at.write_text('{\n "cash": 5.0\n}')
    assert [r.cash for r in review.read_portfolio(spark, str(at), "cash double").collect()] == [5.0]
    at.write_text('{"cash": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        review.read_portfolio(spark, str(at), "cash double").collect()


def test_scores_of_a_case_replace_their_own(spark, tmp_path):
    at = str(tmp_path / "scores")
    review.write_scores(spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, score int"), at)
    review.write_scores(spark.createDataFrame([("b", 3)], "case_id string, score int"), at)
    assert sorted((r.case_id, r.score) for r in spark.read.json(at).collect()) == [("a", 1), ("b", 3)]


def test_verdicts_need_their_fields(spark):
    whole = dict.fromkeys(review.VERDICT_FIELDS, "x") | {"passed": True, "execution_identity": {"uid": 1}}
    lacking = {k: v for k, v in whole.items() if k != "canary"}
    rows = [("whole", json.dumps(whole)), ("lacking", json.dumps(lacking)), ("flat", json.dumps(whole | {"execution_identity": "x"})), ("list", "[]"), ("cut", "{"), ("none", None)]
    got = {r.file: r.verdict for r in review.recorded_verdicts(spark.createDataFrame(rows, "file string, text string")).collect()}
    assert {k for k, v in got.items() if v} == {"whole"} and got["whole"].passed and got["whole"].execution_identity == {"uid": "1"}


def test_links_past_the_top_and_of_no_file(spark):
    text = "[a](../../raw/x.md) [b](../raw/x.md) [c](../../../raw/x.md) [d](../raw/none.md) ![e](../raw/x.md) [f](http://h/raw/x.md)"
    files = spark.createDataFrame([("w/c/p.md", text), ("w/c/q.md", None)], "path string, text string")
    got = {r.target: r.suggestion for r in review.link_repairs(files, spark.createDataFrame([("raw/x.md",), ("raw/x.md",)], "path string")).collect()}
    assert got == {"../raw/x.md": "../../raw/x.md", "../../../raw/x.md": "../../raw/x.md", "../raw/none.md": None}


def test_reports_and_primary_sources(spark):
    paths = spark.createDataFrame([("raw/a/x.md",), ("raw/a/b/y.md",), ("raw/top.md",), ("knowledge/wiki/health/citation-audit-1.md",), ("knowledge/wiki/health/other.md",)], "path string")
    assert [r.source for r in review.primary_sources(paths).collect()] == ["a"]
    assert [r.path for r in paths.where(review.health_report(F.col("path"))).collect()] == ["knowledge/wiki/health/citation-audit-1.md"]
