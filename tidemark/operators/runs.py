"""Evaluation runs: results held to their schemas, fingerprints of run matrices, and the states of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import schemas, values
from . import evaluation

_TEXT, _SAID, _LEVEL = {"type": "string"}, {"type": "string", "minLength": 1}, {"type": ["number", "null"]}
_SHARE = {"type": "number", "minimum": 0, "maximum": 1}
#: What an analyst's output and a judge's verdict must hold.
ANALYSIS = {
    "type": "object",
    "additionalProperties": False,
    "required": ["narrative", "evidence", "direction", "trigger", "invalidation", "confidence", "structure", "phase", "event"],
    "properties": {
        "analysis_id": _TEXT, "direction": {"enum": ["up", "down", "none"]}, "trigger": _LEVEL, "invalidation": _LEVEL, "confidence": _SHARE, "structure": _SAID, "phase": _SAID, "event": _SAID, "event_type": _TEXT,
        "narrative": _SAID, "thesis": _TEXT, "evidence": {"type": "array", "minItems": 1, "items": _SAID}, "forecast": {"type": "object"}, "rationale": _TEXT, "notes": _TEXT,
    },
}
JUDGED = ["structure", "phase", "event", "narrative_quality", "calibration"]
VERDICT = {
    "type": "object",
    "additionalProperties": False,
    "required": JUDGED,
    "properties": {d: {"$ref": "#/$defs/dimension"} for d in JUDGED},
    "$defs": {"dimension": {"type": "object", "additionalProperties": False, "required": ["score", "rationale"], "properties": {"score": _SHARE, "rationale": _TEXT}}},
}
#: States of a run, and the errors that looking at its result may set.
STATUSES = ["pending", "running", "succeeded", "failed", "skipped"]
CORRUPT, STALE = "corrupt_result", "stale_running"


def result_validity(results: DataFrame, raw: str = "raw") -> DataFrame:
    """H-13: ``results`` with ``analyst_ok`` (its analysis is valid) and ``complete`` (and so is its verdict).

    A result without a verdict, or with a null one, is half done; one with a broken verdict counts for nothing.
    """
    whole = F.try_parse_json(raw)
    entries = F.try_variant_get(whole, "$", "map<string,variant>")
    part = lambda k: F.try_element_at(entries, F.lit(k))
    judged = part("judge_verdict").isNotNull() & (F.coalesce(F.schema_of_variant(part("judge_verdict")), F.lit("VOID")) != "VOID")
    seen = results.withColumns({"_analysis": schemas.valid(part("analysis_output"), ANALYSIS), "_judged": F.coalesce(judged, F.lit(False)), "_verdict": schemas.valid(part("judge_verdict"), VERDICT)})
    return seen.select(*results.columns, (F.col("_analysis") & (~F.col("_judged") | F.col("_verdict"))).alias("analyst_ok"), (F.col("_analysis") & F.col("_judged") & F.col("_verdict")).alias("complete"))


def spec_json(columns: list[str]) -> Column:
    """A spec's compact JSON, keys in order."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def manifest_fingerprint(specs: DataFrame, order: str = "run_no", leave_out: tuple[str, ...] = ("missing_snapshot",)) -> str:
    """F-22: SHA-256 of the list of specs in the order of ``order``, without the fields that may change; strings of ASCII hash as JSON everywhere.

    The list is that of one run matrix; it is put together in one place, as a hash of a list must be.
    """
    kept = [c for c in specs.columns if c != order and c not in leave_out]
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), spec_json(kept).alias("j")))), lambda x: x["j"])
    return specs.agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256)).first()[0]


def initialised(state: DataFrame | None, specs: DataFrame, fingerprint: str, known: str | None, reset: bool = False) -> DataFrame:
    """H-14: states with a blank record for each run that has none; states of another matrix are refused unless they are reset."""
    if state is not None and not reset and known != fingerprint:
        raise ValueError("the states belong to another run matrix; reset them after looking at the new one")
    provider = F.when(F.col("model") == "codex", "codex").otherwise("claude")
    none = F.lit(None).cast("string")
    blank = specs.select("run_id", F.lit("pending").alias("status"), F.lit("analyst").alias("stage"), F.lit("analyst").alias("next_stage"), F.lit(0).alias("attempt"), provider.alias("provider"), none.alias("error"))
    if state is None or reset:
        return blank
    return state.unionByName(blank.join(state, "run_id", "left_anti"))


def reconciled(state: DataFrame, results: DataFrame) -> DataFrame:
    """B-18, H-13: states after looking at the results (run_id, analyst_ok, complete), with the error that this sets."""
    j = state.join(results.select("run_id", "analyst_ok", "complete", F.lit(True).alias("found")), "run_id", "left")
    done, half, broken = (F.coalesce(c, F.lit(False)) for c in ("complete", "analyst_ok", "found"))
    stale = F.col("status") == "running"
    pick = lambda d, h, b, s, other: F.when(done, d).when(half, h).when(broken, b).when(stale, s).otherwise(other)
    new = {
        "status": pick("succeeded", "pending", "failed", "pending", F.col("status")), "stage": pick("judge", "judge", F.col("stage"), F.col("stage"), F.col("stage")),
        "next_stage": pick(F.lit(None), F.lit("judge"), F.col("next_stage"), F.coalesce("stage", F.lit("analyst")), F.col("next_stage")), "error": pick(F.lit(None), F.lit(None), F.lit(CORRUPT), F.lit(STALE), F.col("error")),
    }
    return j.select(*(new.get(c, F.col(c)).alias(c) for c in state.columns))


def claimed(state: DataFrame, run_ids: DataFrame, max_attempts: int) -> DataFrame:
    """B-18: states after claiming runs: those that are free run in their next stage, one attempt more, without an error."""
    asked = run_ids.select("run_id").distinct().withColumn("asked", F.lit(True))
    free = F.col("asked").isNotNull() & ~F.col("status").isin("succeeded", "skipped", "running") & (F.col("attempt") < max_attempts)
    new = {"status": F.lit("running"), "stage": F.coalesce("next_stage", "stage", F.lit("analyst")), "attempt": F.col("attempt") + 1, "error": F.lit(None).cast("string")}
    return state.join(asked, "run_id", "left").select(*(F.when(free, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.columns))


#: Why a result gives no row, in the order in which it is asked.
SKIPS = ["unfilled", "no_spec", "no_answer_key", "verdict"]


def _said(results: DataFrame) -> DataFrame:
    """The fields of each result's JSON that count: the forecast, the judged dimensions, tokens; nulls where they are missing."""
    whole = F.try_parse_json("raw")
    at = lambda path, kind: F.try_variant_get(whole, f"$.{path}", kind)
    return results.select(
        "run_id", at("analysis_output", "variant").isNotNull().alias("filled"), *(at(f"analysis_output.{c}", kind).alias(f"said_{c}") for c, kind in (("direction", "string"), ("trigger", "double"), ("invalidation", "double"), ("confidence", "double"))),
        *(at(f"judge_verdict.{d}.score", "double").alias(d) for d in JUDGED), at("usage.input_tokens", "bigint").alias("tokens_in"), at("usage.output_tokens", "bigint").alias("tokens_out"),
    )


def scored(results: DataFrame, specs: DataFrame, answers: DataFrame, walk: DataFrame, prices: DataFrame, digits: int | None = 4) -> DataFrame:
    """B-08, J-09, H-12: a benchmark row for each result (run_id, raw), with ``skip``, why it has no scores, or null.

    ``specs``: run_id, case_id, model, effort, time_mode, anon_mode; ``answers``: case_id, event_type,
    realized_direction, decisive, analysis_mode; ``walk``: case_id, i, high, low, the bars after each case's
    cutoff; ``prices``: model, price_in, price_out.  One lineage from the result's text to its row: forecasts
    meet only their own case's bars, and costs their model's price.
    """
    j = _said(results).join(specs.withColumn("has_spec", F.lit(True)), "run_id", "left").join(answers.withColumn("has_key", F.lit(True)), "case_id", "left")
    sound = F.lit(True)
    for d in JUDGED:
        sound = sound & F.coalesce(F.col(d).between(0.0, 1.0), F.lit(False))
    skip = F.when(~F.coalesce("filled", F.lit(False)), SKIPS[0]).when(F.col("has_spec").isNull(), SKIPS[1]).when(F.col("has_key").isNull(), SKIPS[2]).when(~sound, SKIPS[3])
    j = j.withColumn("skip", skip)
    open_ = j.where("skip is null")
    forecasts = open_.select(F.col("run_id").alias("id"), *(F.col(f"said_{c}").alias(c) for c in ("direction", "trigger", "invalidation", "confidence")), "analysis_mode", "decisive", "realized_direction")
    bars = open_.select(F.col("run_id").alias("id"), "case_id").join(walk, "case_id").select("id", "i", "high", "low")
    found = evaluation.deterministic(forecasts, bars).withColumnRenamed("id", "run_id")
    dimensions = j.join(found.select("run_id", "direction", "trigger", "invalidation", "wait_case", "outcome"), "run_id", "left")
    rows = evaluation.with_cost(evaluation.combined(dimensions, digits), prices, None)
    total = F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))
    earned = values.roi(F.col("aggregate"), F.col("cost_usd"), total, F.col("roi_basis") == "usd", digits)
    if_scored = lambda c: F.when(F.col("skip").isNull(), c)
    return rows.select(
        "run_id", "case_id", "model", "effort", "time_mode", "anon_mode", "event_type", "skip", *(if_scored(F.col(c)).alias(c) for c in ("aggregate", "expert_alignment", "realized_outcome", *evaluation.WEIGHTS, "outcome", "wait_case", "cost_usd", "roi_basis")),
        if_scored(total).alias("total_tokens"), if_scored(earned).alias("roi"),
    )


def covered(rows: DataFrame, events: list[str]) -> tuple[DataFrame, Observation]:
    """B-24: ``rows`` and counters that are filled as they are first written or counted: considered, scored, one for each reason and each event type of scored rows."""
    seen = Observation("coverage")
    counts = [F.count("*").alias("considered"), F.count_if(F.col("skip").isNull()).alias("scored"), *(F.count_if(F.col("skip") == s).alias(s) for s in SKIPS), *(F.count_if(F.col("skip").isNull() & (F.col("event_type") == e)).alias(f"event_{e}") for e in events)]
    return rows.observe(seen, *counts), seen


def uncovered(answers: DataFrame, events: list[str], least: int = 1) -> DataFrame:
    """B-24: event types that fewer than ``least`` answers have, with how many do."""
    spark = answers.sparkSession
    wanted = spark.createDataFrame([(e,) for e in events], "event_type string")
    return wanted.join(answers.groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)
