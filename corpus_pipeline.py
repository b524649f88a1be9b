"""A training corpus from raw documents: five stages, each by one of the corpus operators.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import contamination, jaccard, mixing, shards, toxicity
from tidemark.llm.common import Tables, read_table
from tidemark.session import ship_package

#: No SQL has these rows: the classifier of the first stage is fitted.  Tests hold copies, decontamination
#: and shards against brute force, the mix against its totals by source, and toxicity against held-out labels.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the chain calls toxic go."""
    ship_package(spark)
    chain = toxicity.fit(docs, toxicity.categorised(read_table(spark, sf_dir, "labels")), ["low_quality", "toxic"])
    return toxicity.clean(docs, chain)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, five-word shingles and a similarity of 0.8: one document of each group stays, that with the least id."""
    ship_package(spark)
    return jaccard.one_of_each(docs, width=5, num=8, den=10)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold ten consecutive words of a benchmark item go."""
    ship_package(spark)
    return contamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document as often as the mix takes it."""
    ship_package(spark)
    return mixing.mixed(docs, weights=[5.0, 2.0, 1.0])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the shard and slot of every row."""
    ship_package(spark)
    return shards.byte_shards(docs, n_shards=24)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", near_copies),
    ("decontamination", decontaminate),
    ("source_mix", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    tables = Tables(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = tables.write(name, docs)
    return docs
