"""Forecast evaluation: snapshots, deterministic and combined scores, run matrices, reports, run state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.symbols import direction_of, is_wait
from ..functions.values import case_index, roi, rounded, run_id, token_cost
from .backtest import replay
from .evidence import folded

#: Weights of the scored dimensions.
WEIGHTS = {"structure": 0.15, "phase": 0.15, "event": 0.15, "direction": 0.15, "trigger": 0.10, "invalidation": 0.10, "narrative_quality": 0.10, "calibration": 0.10}
DETERMINISTIC = ["direction", "trigger", "invalidation"]
SEMANTIC = ["structure", "phase", "event"]
JUDGED = ["structure", "phase", "event", "narrative_quality", "calibration"]
#: The three angles, by name: time mode and name mode.
ANGLES = {"baseline": ("blind", "anon"), "leakage": ("blind", "revealed"), "lookahead": ("future_visible", "anon")}
DAY_MS = 86_400_000
#: Unusual price levels and volume factors of anonymised cases.
PRICE_TARGETS = [333.33, 9999.1, 88000.0, 0.00317, 555555.0, 0.314]
VOLUME_FACTORS = [0.001, 10000.0, 0.00001, 50000.0, 0.1, 100000.0]
PRICES = ["open", "high", "low", "close"]


def coefficients(slices: DataFrame, price_targets: list[float] = PRICE_TARGETS, volume_factors: list[float] = VOLUME_FACTORS) -> DataFrame:
    """B-11, A-12, F-18: case_id with price and volume coefficient and target, from the median close of its bars; cases without a usable one go."""
    at = case_index(F.col("case_id"), len(price_targets))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), at)
    mid = slices.groupBy("case_id").agg(F.median("close").alias("mid")).where("mid <> 0")
    out = mid.select("case_id", F.round(pick(price_targets) / F.col("mid"), 8).alias("price_coef"), F.round(pick(volume_factors), 8).alias("volume_coef"), pick(price_targets).alias("price_target"))
    return out.where("price_coef <> 0")


def anonymised(slices: DataFrame, coefs: DataFrame, start_index: int = 0, digits: int | None = 4) -> DataFrame:
    """B-11, Q-21: bars in a case's own price space; time steps one day a bar from the epoch on, whatever the timeframe."""
    i = F.row_number().over(W.Window.partitionBy("case_id").orderBy("open_time")) - 1 + start_index
    j = slices.withColumn("i", i).join(coefs, "case_id")
    return j.select("case_id", (F.col("i").cast("long") * DAY_MS).alias("open_time"), *(rounded(F.col(p) * F.col("price_coef"), digits).alias(p) for p in PRICES), rounded(F.col("volume") * F.col("volume_coef"), digits).alias("volume"))


def passthrough(slices: DataFrame) -> DataFrame:
    """B-12: bars in real space at the same width."""
    return slices.select("case_id", "open_time", *(F.round(p, 4).alias(p) for p in [*PRICES, "volume"]))


def snapshot(cases: DataFrame, bars: DataFrame, mode: str = "blind", future_bars: int = 10, reveal: bool = False, price_targets: list[float] = PRICE_TARGETS, volume_factors: list[float] = VOLUME_FACTORS, digits: int | None = 4) -> tuple[DataFrame, DataFrame]:
    """B-13, Q-13, Q-22: (visible, post) bars of each case (case_id, symbol, cutoff_ms, n_bars).

    Visible are the last ``n_bars`` up to the cutoff, and in mode ``future_visible`` the ``future_bars`` after
    it as well.  Post starts with the cutoff's own bar, in the price space of the visible slice.
    """
    if reveal and mode == "future_visible":
        raise ValueError("a revealed case can't show its future")
    joined = cases.join(bars.select("symbol", "open_time", *PRICES, "volume"), "symbol")
    before = F.col("open_time") <= F.col("cutoff_ms")
    by = W.Window.partitionBy("case_id", before)
    back = F.when(before, F.row_number().over(by.orderBy(F.col("open_time").desc())))
    ahead = F.when(~before, F.row_number().over(by.orderBy("open_time")))
    placed = joined.withColumn("back", back).withColumn("ahead", ahead)
    shown = F.col("back") <= F.col("n_bars")
    if mode == "future_visible":
        shown = shown | (F.col("ahead") <= future_bars)
    visible = placed.where(shown)
    post = placed.where((F.col("back") == 1) | (F.col("ahead") <= future_bars))
    if reveal:
        return passthrough(visible), passthrough(post)
    coefs = coefficients(visible, price_targets, volume_factors)
    offset = anonymised(post, coefs, digits=digits).join(cases.select("case_id", "n_bars"), "case_id").withColumn("open_time", F.col("open_time") + (F.col("n_bars") - 1).cast("long") * DAY_MS).drop("n_bars")
    return anonymised(visible, coefs, digits=digits), offset


def deterministic(forecasts: DataFrame, walk: DataFrame) -> DataFrame:
    """B-05, B-06, Q-14, Q-15: outcome and the three deterministic scores of each forecast.

    ``forecasts``: id, direction, trigger, invalidation, confidence, analysis_mode, decisive, realized_direction;
    ``walk``: id, i, high, low.  Retrospective cases and low-confidence waits on undecided cases aren't scored.
    """
    said = direction_of(F.col("direction"))
    retro = F.coalesce(F.col("analysis_mode") == "retrospective", F.lit(False))
    wait = ~retro & F.coalesce(~F.col("decisive"), F.lit(False)) & is_wait(F.col("direction"), F.col("confidence"))
    f = forecasts.withColumn("said", said).withColumn("retro", retro).withColumn("wait_case", wait)
    moving = f.where(~F.col("retro") & ~F.col("wait_case") & F.col("said").isin("up", "down")).select("id", F.when(F.col("said") == "up", "long").otherwise("short").alias("side"), F.col("invalidation").alias("stop"), F.col("trigger").alias("target"))
    got = f.join(replay(moving, walk).select("id", "outcome", "resolved_at"), "id", "left")
    scored = ~F.col("retro") & ~F.col("wait_case")
    outcome = F.when(scored, F.coalesce("outcome", F.lit("open")))
    fallback = F.col("realized_direction").isNull()
    real = F.when(fallback, F.when(F.col("outcome") == "hit_tp", F.col("said")).otherwise("none")).otherwise(direction_of(F.col("realized_direction")))
    one = lambda c: F.when(scored, F.when(c, 1.0).otherwise(0.0))
    return got.select(
        "id", outcome.alias("outcome"), F.when(scored, F.col("resolved_at")).alias("bars_to_resolution"), "wait_case", (scored & fallback).alias("used_fallback"),
        one(F.col("said") == real).alias("direction"), one(F.coalesce(F.col("outcome") == "hit_tp", F.lit(False))).alias("trigger"), one(~F.coalesce(F.col("outcome") == "hit_sl", F.lit(False))).alias("invalidation"),
    )


def weighted(names: list[str], digits: int | None = 4) -> Column:
    """A-15: weighted mean over the dimensions that are scored; null if none is."""
    num = sum((F.when(F.col(n).isNotNull(), F.col(n) * WEIGHTS[n]).otherwise(0.0) for n in names), F.lit(0.0))
    den = sum((F.when(F.col(n).isNotNull(), F.lit(WEIGHTS[n])).otherwise(0.0) for n in names), F.lit(0.0))
    return rounded(F.when(den > 0, num / den), digits)


def combined(dimensions: DataFrame, digits: int | None = 4) -> DataFrame:
    """A-16, B-07: add aggregate (0 if nothing is scored), expert_alignment and realized_outcome to one column a dimension.

    Judged dimensions are required: a row that lacks one has ``verdict_ok`` false.
    """
    ok = F.lit(True)
    for n in JUDGED:
        ok = ok & F.col(n).isNotNull() & F.col(n).between(0.0, 1.0)
    return dimensions.withColumn("aggregate", F.coalesce(weighted(list(WEIGHTS), digits), F.lit(0.0))).withColumn("expert_alignment", weighted(SEMANTIC, digits)).withColumn("realized_outcome", weighted(DETERMINISTIC, digits)).withColumn("verdict_ok", F.coalesce(ok, F.lit(False)))


def run_matrix(cases: DataFrame, models: DataFrame, control_models: list[str] | None = None, control_efforts: list[str] | None = None) -> DataFrame:
    """J-11, H-11: a run for each case, angle, model and effort; controls only in their scope (all, if none is given)."""
    spark = cases.sparkSession
    angles = spark.createDataFrame([(k, t, a) for k, (t, a) in ANGLES.items()], "control string, time_mode string, anon_mode string")
    scope = F.lit(True)
    if control_models:
        scope = scope & F.col("model").isin(control_models)
    if control_efforts:
        scope = scope & F.col("effort").isin(control_efforts)
    pairs = F.broadcast(angles.crossJoin(models)).where((F.col("control") == "baseline") | scope)  # three rows a model and effort
    out = cases.select("case_id").crossJoin(pairs)
    suffix = F.when(F.col("anon_mode") == "revealed", "__revealed").when(F.col("time_mode") == "future_visible", "__fv").otherwise("")
    return out.withColumn("run_id", run_id(*map(F.col, ("case_id", "time_mode", "anon_mode", "model", "effort")))).withColumn("snapshot_name", F.concat("case_id", suffix))


def parse_run_ids(ids: DataFrame) -> DataFrame:
    """S-11: parts of run ids; ``run_ok`` is false unless there are five."""
    p = F.split("run_id", "__")
    ok = F.size(p) == 5
    return ids.select("*", ok.alias("run_ok"), *(F.when(ok, F.get(p, F.lit(i))).alias(n) for i, n in enumerate(("case_id", "time_mode", "anon_mode", "model", "effort"))))


def ingest(results: DataFrame, manifest: DataFrame, answers: DataFrame) -> DataFrame:
    """J-09, S-12: results with the reason why they can't be scored, or null."""
    j = results.join(manifest.withColumn("has_spec", F.lit(True)), "run_id", "left").join(answers.withColumn("has_key", F.lit(True)), "case_id", "left")
    return j.withColumn("skip", F.when(~F.col("filled"), "unfilled").when(F.col("has_spec").isNull(), "no_spec").when(F.col("has_key").isNull(), "no_answer_key")).drop("has_spec", "has_key")


def with_cost(rows: DataFrame, prices: DataFrame, digits: int | None = 4) -> DataFrame:
    """F-19, F-20, Q-17: add total_tokens, cost_usd, roi and roi_basis; the basis is the model's, not the row's."""
    p = rows.join(prices, "model", "left")
    priced = F.col("price_in").isNotNull()
    cost = token_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))
    total = F.col("tokens_in") + F.col("tokens_out")
    out = p.withColumn("total_tokens", total).withColumn("cost_usd", cost)
    return out.withColumn("roi", roi(F.col("aggregate"), F.col("cost_usd"), F.col("total_tokens"), priced, digits)).withColumn("roi_basis", F.when(priced, "usd").otherwise("tokens")).drop("price_in", "price_out")


def group_report(rows: DataFrame, digits: int | None = 4) -> DataFrame:
    """A-17, A-18: one row for each model and effort of the baseline angle; means skip nulls."""
    base = rows.where((F.col("time_mode") == "blind") & (F.col("anon_mode") == "anon"))
    mean = lambda c: rounded(F.avg(c), digits).alias(f"mean_{c}")
    return base.groupBy("model", "effort").agg(F.count("*").alias("n"), *(mean(c) for c in ("aggregate", "expert_alignment", "realized_outcome", "total_tokens", "cost_usd", "roi")), F.first("roi_basis").alias("roi_basis"))


def event_means(rows: DataFrame, digits: int | None = 4) -> DataFrame:
    """A-17: means of the baseline by event type."""
    base = rows.where((F.col("time_mode") == "blind") & (F.col("anon_mode") == "anon"))
    return base.groupBy("model", "effort", "event_type").agg(F.count("*").alias("n"), rounded(F.avg("aggregate"), digits).alias("mean_aggregate"))


def ranked(groups: DataFrame) -> DataFrame:
    """A-19, O-03, O-04: rank by aggregate, and by return within each basis (null last); ties by model and effort."""
    name = [F.col("model").asc(), F.col("effort").asc()]
    score = W.Window.orderBy(F.col("mean_aggregate").desc_nulls_last(), *name)  # as many rows as models and efforts
    gain = W.Window.partitionBy("roi_basis").orderBy(F.col("mean_roi").desc_nulls_last(), *name)
    return groups.withColumn("rank_aggregate", F.row_number().over(score)).withColumn("rank_roi", F.row_number().over(gain))


def paired_delta(rows: DataFrame, to: str, digits: int | None = 4) -> DataFrame:
    """J-10, A-20, Q-16: mean of an angle's aggregate less the baseline's over the cases that have both; the last row of a case counts."""
    time_mode, anon_mode = ANGLES[to]
    a = (F.col("time_mode") == "blind") & (F.col("anon_mode") == "anon")
    b = (F.col("time_mode") == time_mode) & (F.col("anon_mode") == anon_mode)
    side = rows.where(a | b).groupBy("model", "effort", "case_id").agg(F.max_by(F.when(a, F.col("aggregate")), F.when(a, F.col("seq"))).alias("x"), F.max_by(F.when(b, F.col("aggregate")), F.when(b, F.col("seq"))).alias("y"))
    d = F.col("y") - F.col("x")
    return side.groupBy("model", "effort").agg(F.count(d).alias("n"), rounded(F.avg(d), digits).alias("delta"))


def reconcile(state: DataFrame, checks: DataFrame) -> DataFrame:
    """B-18, H-13: run states after looking at results: run_id, status, stage, next_stage.

    ``checks``: run_id, analyst_ok, complete.  Interrupted runs without a result are pending again.
    """
    j = state.join(checks.withColumn("found", F.lit(True)), "run_id", "left")
    done, half, broken = F.coalesce("complete", F.lit(False)), F.coalesce("analyst_ok", F.lit(False)), F.col("found").isNotNull()
    stale = F.col("status") == "running"
    pick = lambda d, h, b, s, o: F.when(done, d).when(half, h).when(broken, b).when(stale, s).otherwise(o)
    status, stage, nxt = F.col("status"), F.col("stage"), F.col("next_stage")
    return j.select(
        "run_id", pick(F.lit("succeeded"), F.lit("pending"), F.lit("failed"), F.lit("pending"), status).alias("status"), pick(F.lit("judge"), F.lit("judge"), stage, stage, stage).alias("stage"),
        pick(F.lit(None), F.lit("judge"), nxt, F.coalesce(stage, F.lit("analyst")), nxt).alias("next_stage"), "attempt",
    )


def initialise(state: DataFrame, specs: DataFrame) -> DataFrame:
    """H-14: states with a blank record for each run that has none."""
    new = specs.select("run_id").join(state, "run_id", "left_anti").select("run_id", F.lit("pending").alias("status"), F.lit("analyst").alias("stage"), F.lit("analyst").alias("next_stage"), F.lit(0).alias("attempt"))
    return state.unionByName(new)


def claimable(state: DataFrame, max_attempts: int) -> DataFrame:
    """B-18: runs that may start, with the stage they would start in."""
    free = ~F.col("status").isin("succeeded", "skipped", "running") & (F.col("attempt") < max_attempts)
    return state.where(free).select("run_id", F.coalesce("next_stage", "stage", F.lit("analyst")).alias("stage"))


#: The modes of an analysis; what the proof of an answer must hold, and what it may; where its source and image lie; how Markdown refers to an image.
ANALYSIS_MODES = ["forward_looking", "retrospective"]
PROVENANCE = ["expert_author", "source_path", "source_url", "source_image_path", "source_excerpt_location", "reconstruction_notes"]
EXPERT_LABELS = ["expert_structure", "expert_phase", "expert_event", "expert_scenario", "expert_trigger", "expert_invalidation"]
SOURCE_ROOT, IMAGE_REFERENCE = "raw/crypto_archive", r"!\[[^\]]*\]\(([^)]+)\)"


def provenance_problems(answers: DataFrame, posts: DataFrame, images: DataFrame) -> DataFrame:
    """B-15: the first broken rule of each answer's proof, or null.

    ``answers``: case_id, the fields of ``PROVENANCE`` and ``EXPERT_LABELS`` (null: missing), the location of the
    excerpt as a struct of start_line and end_line; ``posts``: path, text; ``images``: path.  An answer meets one
    post and one image; the excerpt's lines must refer to that image, relative to the post.
    """
    inside = lambda p: F.coalesce((p == SOURCE_ROOT) | p.startswith(f"{SOURCE_ROOT}/"), F.lit(False))
    a = answers.withColumns({"_post": folded(F.col("source_path")), "_image": folded(F.col("source_image_path"))})
    a = a.join(posts.select(F.col("path").alias("_post"), F.col("text").alias("_text")), "_post", "left").join(images.select(F.col("path").alias("_image"), F.lit(True).alias("_there")).distinct(), "_image", "left")
    start, end = F.col("source_excerpt_location.start_line"), F.col("source_excerpt_location.end_line")
    # explode keeps the lines from being split anew for every use
    a = a.withColumn("_lines", F.explode(F.array(F.split(F.coalesce("_text", F.lit("")), "\n"))))
    n_lines = F.size("_lines") - F.when(F.element_at("_lines", -1) == "", 1).otherwise(0)
    refs = F.flatten(F.transform(F.slice("_lines", F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), lambda x: F.regexp_extract_all(x, F.lit(IMAGE_REFERENCE), F.lit(1))))
    beside = F.regexp_replace("_post", "[^/]*$", "")
    shown = F.exists(refs, lambda r: ~F.trim(r).rlike("^(https?://|$)") & F.coalesce(folded(F.concat(beside, F.trim(r))) == F.col("_image"), F.lit(False)))
    texts = sorted([*(f for f in PROVENANCE if f != "source_excerpt_location"), *EXPERT_LABELS])
    empty = F.coalesce(*(F.when(F.trim(F.col(f)) == "", F.lit(f"{f}_empty")) for f in texts))
    lacking = reduce(lambda x, y: x | y, (F.col(f).isNull() for f in PROVENANCE))
    problem = (
        F.when(lacking, "provenance_missing").when(empty.isNotNull(), empty).when(~inside(F.col("_post")), "source_path_outside").when(~inside(F.col("_image")), "image_path_outside").when(F.col("_text").isNull(), "source_path_not_there").when(F.col("_there").isNull(), "image_path_not_there")
        .when(start.isNull() | end.isNull(), "excerpt_not_lines").when((start < 1) | (end < start), "excerpt_order").when(end > n_lines, "excerpt_beyond_file").when(~shown, "image_not_referenced")
    )
    return a.select("case_id", problem.alias("problem"))


def case_problems(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """B-15, A-23: the first broken rule of each case, or null."""
    n = F.count("*").over(W.Window.partitionBy("case_id"))
    j = cases.withColumn("copies", n).join(answers.withColumn("has_key", F.lit(True)), "case_id", "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    retro = F.col("analysis_mode") == "retrospective"
    problem = (
        F.when(blank("symbol"), "symbol_empty").when(blank("timeframe"), "timeframe_empty").when(~F.coalesce(F.col("n_bars") > 0, F.lit(False)), "n_bars_not_positive").when(F.col("has_key").isNull(), "answer_missing")
        .when(~F.coalesce(F.col("analysis_mode").isin(ANALYSIS_MODES), F.lit(False)), "analysis_mode_unknown").when(blank("event_type"), "event_type_empty")
        .when(retro & (F.col("realized_direction") != "not_applicable"), "retrospective_direction").when(~retro & ~F.coalesce(F.col("realized_direction").isin("up", "down", "none"), F.lit(False)), "forward_direction")
        .when(F.col("decisive").isNull(), "decisive_missing").when(blank("ground_truth"), "ground_truth_empty").when(F.col("copies") > 1, "case_id_repeated")
    )
    return j.select("case_id", problem.alias("problem"))


def placeholder_answers(spark: SparkSession, n: int) -> DataFrame:
    """B-14: stand-in answers; every third is retrospective."""
    retro = F.col("id") % 3 == 2
    return spark.range(n).select(F.format_string("case_%02d", F.col("id") + 1).alias("case_id"), F.when(retro, "retrospective").otherwise("forward_looking").alias("analysis_mode"), F.when(retro, "not_applicable").otherwise("up").alias("realized_direction"), F.lit(True).alias("decisive"))
