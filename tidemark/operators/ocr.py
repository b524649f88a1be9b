"""Readings of chart images: the artifact that holds them, the files they were taken from, and what they say against cards.

An artifact is accepted by its contract, a schema compiled to one expression; readings meet image files by path
and by the SHA-256 of the bytes, which Spark reads where they lie, so a reading of another version of an image
never speaks against a card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import schemas
from ..functions.values import asset_name, asset_parts, chart_timeframe
from .evidence import source_kind

#: The contract of an artifact, and the codes of findings.
SCHEMA, PARSER, LEAST_CONFIDENCE, RUNS, ENGINE, LANGUAGE = "fraser-header-ocr/v1", 10, 0.85, 2, "Apple Vision VNRecognizeTextRequest accurate", "en-US"
STALE, CONTRADICTION = "W-EXTRACT-OCR-EVIDENCE-SKIPPED", "F-EXTRACT-OCR-METADATA-CONTRADICTION"
CONTRACT = {
    "type": "object",
    "required": ["schema", "generator", "images"],
    "properties": {
        "schema": {"const": SCHEMA},
        "generator": {
            "type": "object",
            "required": ["parser_version", "minimum_confidence", "runs_per_image", "engine", "recognition_language", "uses_language_correction", "toolchain"],
            "properties": {
                "parser_version": {"const": PARSER}, "minimum_confidence": {"const": LEAST_CONFIDENCE}, "runs_per_image": {"const": RUNS}, "engine": {"const": ENGINE}, "recognition_language": {"const": LANGUAGE},
                "uses_language_correction": {"const": False}, "toolchain": {"type": "object"},
            },
        },
        "images": {"type": "array", "items": {"type": "object", "required": ["image_path"], "properties": {"image_path": {"type": "string", "minLength": 1}}}},
    },
}


def _images(payload: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(payload), "$.images", "array<variant>")


def _get(v: Column, at: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{at}", kind)


def artifact_problem(artifacts: DataFrame) -> DataFrame:
    """S-18: ``artifacts`` (payload, a JSON text) with ``problem``: not_json, contract or repeated_image, or null."""
    paths = F.transform(_images(F.col("payload")), lambda x: _get(x, "image_path", "string"))
    problem = F.when(F.try_parse_json("payload").isNull(), "not_json").when(~schemas.valid_json(F.col("payload"), CONTRACT), "contract").when(F.size(F.array_distinct(paths)) < F.size(paths), "repeated_image")
    return artifacts.withColumn("problem", problem)


def _agreed(reading: Column) -> Column:
    """T-20 in part: the value of a field on which all runs agree and that may decide, or null; the boxes are not parsed again."""
    value, runs = _get(reading, "value", "string"), _get(reading, "runs", "array<string>")
    same = (F.size(runs) == RUNS) & F.forall(runs, lambda r: r.eqNullSafe(value)) & (F.size(_get(reading, "evidence", "array<variant>")) == RUNS)
    text = F.schema_of_variant(_get(reading, "value", "variant")) == "STRING"
    return F.when(_get(reading, "decision_eligible", "boolean") & text & (value != "") & (F.lower(value) != "unknown") & F.coalesce(same, F.lit(False)), value)


def _members(asset: Column) -> Column:
    """The assets of a reading on which all runs agree, normalised and sorted, or null."""
    found, runs = _get(asset, "members", "array<string>"), _get(asset, "member_runs", "array<array<string>>")
    names = F.transform(found, asset_name)
    sound = (F.size(found) > 0) & F.forall(names, lambda n: F.coalesce(n != "", F.lit(False))) & (F.size(F.array_distinct(names)) == F.size(names))
    same = (F.size(runs) == RUNS) & F.forall(runs, lambda r: r.eqNullSafe(found)) & (F.size(_get(asset, "member_evidence", "array<variant>")) == RUNS)
    return F.when(_get(asset, "members_decision_eligible", "boolean") & F.coalesce(sound & same, F.lit(False)), F.array_sort(names))


def observations(artifacts: DataFrame) -> DataFrame:
    """A row for each image of accepted artifacts: image_path, sha256, asset, timeframe, members (null where not agreed) and has_members."""
    each = artifact_problem(artifacts).where("problem is null").select(F.explode(_images(F.col("payload"))).alias("x"))
    x = F.col("x")
    asset = _get(x, "asset", "variant")
    return each.select(_get(x, "image_path", "string").alias("image_path"), _get(x, "sha256", "string").alias("sha256"), _agreed(asset).alias("asset"), _agreed(_get(x, "timeframe", "variant")).alias("timeframe"), _members(asset).alias("members"), F.coalesce(_get(asset, "members", "variant").isNotNull(), F.lit(False)).alias("has_members"))


def image_files(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """S-16, J-17: image_path (from the root), bytes and sha256 of every file under ``root/folder``; no content leaves its task."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/{folder}")
    at = F.concat(F.lit(f"{folder}/"), F.regexp_extract("path", f"/{folder}/(.*)$", 1))
    return read.select(at.alias("image_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("actual"))


def evidence_findings(cards: DataFrame, seen: DataFrame, files: DataFrame) -> DataFrame:
    """J-17, T-16: path, code, field of cards (path, source, image_path, asset, timeframe) that readings speak against.

    Readings of other bytes than the file's are skipped, with a warning once an image, at its first card by path.
    Cards whose image has no reading, or no file, have none here.  A declaration of several assets must name the
    same set as the reading does; without agreed members it must hold the one that was read.
    """
    mine = cards.where((source_kind(F.col("source")) == "fraser") & ~F.col("image_path").startswith("(remote:")).withColumnsRenamed({"asset": "said_asset", "timeframe": "said_timeframe"})
    met = mine.join(seen, "image_path").join(files.select("image_path", "actual"), "image_path")
    fresh = F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("sha256") == F.col("actual")), F.lit(False))
    stale = met.where(~fresh).withColumn("n", F.row_number().over(W.Window.partitionBy("image_path").orderBy("path"))).where("n = 1")
    parts, read = asset_parts(F.col("said_asset")), asset_name(F.col("asset"))
    several = F.size(parts) > 1
    equal = F.when(several & F.col("has_members"), parts == F.col("members")).when(several, F.array_contains(parts, read)).otherwise(parts == F.array(read))
    stated = lambda c: (F.trim(c) != "") & (F.lower(F.trim(c)) != "unknown")
    wrong_asset = stated(F.col("said_asset")) & (asset_name(F.col("said_asset")) != "") & (read != "") & ~equal
    mine_tf, read_tf = chart_timeframe(F.col("said_timeframe")), chart_timeframe(F.col("timeframe"))
    wrong_tf = stated(F.col("said_timeframe")) & (mine_tf != read_tf)
    against = lambda name, test: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    fields = F.array_compact(F.array(against("asset", wrong_asset), against("timeframe", wrong_tf)))
    told = met.where(fresh).select("path", F.lit(CONTRADICTION).alias("code"), F.explode(fields).alias("field"))
    return told.unionByName(stale.select("path", F.lit(STALE).alias("code"), F.lit(None).cast("string").alias("field")))
