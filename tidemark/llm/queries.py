"""The thin queries over the whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codes, contamination, jaccard, lines, mixing, normalise, oracles, quality, secrets, shards, tokens, toxicity, turns, winnow
from .common import read_table

TOKENIZER = "byte_bpe_50k.json"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeats(read_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(read_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.prefix_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    out = counted.select("doc_id", "n_bytes", tokens.n_tokens().alias("n_tokens"), tokens.fits(1024).alias("fits_1024"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fits_1024")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, toxicity.categorised(read_table(spark, sf_dir, "labels")), ["low_quality", "toxic"])
    return toxicity.score(docs, chain, ["doc_id"]).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, taken = mixing.mix(read_table(spark, sf_dir, "documents"), weights=[5.0, 2.0, 1.0])
    return taken.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.round_trip(read_table(spark, sf_dir, "pages"))


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.byte_shards(read_table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    out = found.select("doc_id", "n_words", contamination.hit_words().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(read_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", codes.hex_code(F.col("codes")).alias("code"), "error", "label_error", F.lit(codes.books_sha256(books)).alias("codebooks_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited, repaired = turns.repair(read_table(spark, sf_dir, "conversations"))
    sha = turns.digests(repaired).withColumnRenamed("conv_id", "of")
    out = audited.join(sha, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.compared(read_table(spark, sf_dir, "documents"))
    prints = [winnow.spelt(F.col(f"{of}places"), F.col(f"{of}hashes")).alias(f"{of}fingerprint") for of in ("", "edited_")]
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", *prints, "near_edited", "near_next")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_ngram_jaccard, op4_token_counts, op5_quality_rules, op6_toxicity, op7_source_mix, op8_warc, op9_byte_shards, op10_contamination, op11_vector_codes, op12_conversation_repair, op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return dict(oracles.SQL)
