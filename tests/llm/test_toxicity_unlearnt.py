"""Operator 6 where nothing can be learnt, at the threshold that the pipeline and the query use."""

from __future__ import annotations

import pytest

from tidemark.llm import queries, toxicity

import corpus_pipeline


@pytest.mark.parametrize("labelled", [[], [(900, 1, 0), (901, 0, 1)], [(1, 1, 0)], [(2, 0, None)]], ids=["none", "of other documents", "no positive", "unknown"])
def test_nothing_learnt_rejects_nothing(spark, tmp_path, labelled):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "some words", "other words here"])], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]
    out = queries.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == 4 and not any(r.toxic for r in out)


def test_evidence_still_rejects(spark):
    docs = spark.createDataFrame([(k, "a b c") for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1, 1) for k in range(40)], "doc_id bigint, quality int, toxic int")
    rows = docs.selectExpr("doc_id", "concat(text, ' x', doc_id) as text")
    chain = toxicity.fit(rows, toxicity.categorised(labels), ["low_quality", "toxic"])
    assert toxicity.clean(rows, chain).count() == 0
