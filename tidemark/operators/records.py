"""Records at rest: signal and journal logs, their shapes, manifests, usage, figures and small projections."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.values import usage_tokens
from . import rules

#: What entries of a journal must hold, the texts of an analysis and of its forecast.
ANALYSIS_FIELDS = ["analysis_id", "logged_at", "symbol", "timeframe", "model", "effort", "narrative", "structure", "phase", "forecast", "review"]
REVIEW_FIELDS = ["reviewed_at", "realized_direction", "hit_trigger", "note"]
ANALYSIS_TEXTS = ["symbol", "timeframe", "model", "effort", "narrative", "structure", "phase"]
FORECAST_TEXTS = ["direction", "trigger", "invalidation"]
#: Answers that may flow on, where article images lie, words that a reader of scans splits, the least figure.
ANSWER_KEYS = ["event_type", "realized_direction", "decisive", "analysis_mode"]
ARTICLE_IMAGES = "https://d.stockcharts.com/img/articles/"
SCAN_ARTIFACTS = ["gre ater", "selle rs", "tra ding", "wycko ff"]
LEAST_FIGURE = 50


def utc_time(bound: str) -> datetime:
    """A stated bound as a time in UTC; without an offset it is one already."""
    at = datetime.fromisoformat(bound)
    return at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)


def months_between(start: str, end: str) -> list[str]:
    """H-17: the months, in UTC, that a range touches."""
    low, high = utc_time(start), utc_time(end)
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in range(low.year * 12 + low.month - 1, high.year * 12 + high.month)]


def _log_lines(spark: SparkSession, folder: str, start: str | None, end: str | None) -> DataFrame:
    """month, place (of the file), line (its number there, from 1) and value of the lines of a log; with both bounds, months out of the range aren't read.

    A log has a folder ``month=YYYY-MM`` for each month, or a file ``YYYY-MM.jsonl``.  Long files are read in
    pieces by many tasks; a line's number is its place in its piece and the lines of the pieces before it.
    """
    months = months_between(start, end) if start and end else None
    by_name = None if months is None else "{" + ",".join([f"{m}.jsonl" for m in months] or ["none"]) + "}"
    read = spark.read.option("pathGlobFilter", by_name or "*.jsonl") if _flat(spark, folder) else spark.read
    lines = read.text(folder)
    if "month" in lines.columns:
        lines = lines.withColumn("month", F.col("month").cast("string"))
        lines = lines if months is None else lines.where(F.col("month").isin(months))
    else:
        lines = lines.withColumn("month", F.regexp_extract("_metadata.file_name", r"^(\d{4}-\d{2})\.jsonl$", 1))
    piece = ["place", "piece"]
    lines = lines.select("month", "value", F.col("_metadata.file_path").alias("place"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("serial"))
    pieces = lines.groupBy(*piece).agg(F.min("serial").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.Window.partitionBy("place").orderBy("piece").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(pieces.withColumn("before", before), piece)
    return numbered.select("month", "place", (F.col("before") + F.col("serial") - F.col("first") + 1).alias("line"), "value").where(F.trim("value") != "")


def _flat(spark: SparkSession, folder: str) -> bool:
    """Whether a log has a file, in place of a folder, for each month."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    return bool(at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(jvm.org.apache.hadoop.fs.Path(at, "*.jsonl")))


def read_signals(spark: SparkSession, folder: str, schema: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """S-07: signals of a log with month, place and line; blank lines, broken ones and those without a time are passed over."""
    got = _log_lines(spark, folder, start, end).select("month", "place", "line", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("month", "place", "line", "r.*")
    at = F.try_to_timestamp("logged_at")
    got = got.where(at.isNotNull())
    for bound, keep in ((start, lambda t: at >= t), (end, lambda t: at <= t)):
        if bound:
            got = got.where(keep(F.lit(utc_time(bound))))
    return got


def _lacking(entry: Column, fields: list[str]) -> Column:
    return F.array_join(F.array_sort(F.filter(F.array(*map(F.lit, fields)), lambda k: ~F.map_contains_key(entry, k))), ", ")


def journal_problem(line: Column) -> Column:
    """H-15: what is wrong with a line of a journal, or null: its JSON, kind, missing fields, time or flag."""
    entry = F.from_json(line, "map<string,string>")
    get = lambda e, k: F.try_element_at(e, F.lit(k))
    kind, review = get(entry, "type"), F.from_json(get(entry, "review"), "map<string,string>")
    timed = lambda e, k: F.try_to_timestamp(get(e, k)).isNotNull()
    of_review = F.when(review.isNull() | get(entry, "analysis_id").isNull(), "review has no shape").when(_lacking(review, REVIEW_FIELDS) != "", F.concat(F.lit("review lacks "), _lacking(review, REVIEW_FIELDS))).when(~F.coalesce(get(review, "hit_trigger").isin("true", "false"), F.lit(False)), "hit_trigger").when(~timed(review, "reviewed_at"), "reviewed_at")
    of_analysis = F.when(_lacking(entry, ANALYSIS_FIELDS) != "", F.concat(F.lit("analysis lacks "), _lacking(entry, ANALYSIS_FIELDS))).when(~timed(entry, "logged_at"), "logged_at")
    return F.when(entry.isNull() | ~F.trim(line).startswith("{"), "not an object").when(kind == "review", of_review).when(kind.isNotNull(), "unsupported type").otherwise(of_analysis)


def _sound(lines: DataFrame) -> DataFrame:
    problem = journal_problem(F.col("value"))
    stop = F.raise_error(F.concat(F.col("place"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), problem)).cast("boolean")
    return lines.where(F.when(problem.isNotNull(), stop).otherwise(F.lit(True)))


def read_journal(spark: SparkSession, folder: str, analysis_schema: str, review_schema: str, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S-08: analyses of the months asked for and reviews of all months; any broken line stops the reading with its file and number."""
    at = ["month", "place", "line"]
    review = F.get_json_object("value", "$.type") == "review"
    analyses = _sound(_log_lines(spark, folder, start, end)).where(~F.coalesce(review, F.lit(False))).select(*at, F.from_json("value", analysis_schema).alias("r"))
    reviews = _sound(_log_lines(spark, folder, None, None)).where(review).select(*at, F.from_json("value", f"analysis_id string, review struct<{review_schema}>").alias("r"))
    return analyses.select(*at, "r.*"), reviews.select(*at, "r.analysis_id", "r.review.*")


def required_text(c: Column) -> Column:
    """H-16: trimmed text; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def analysis_problem() -> Column:
    """K-02: the first field of a new analysis (columns, and ``forecast`` as a struct) that breaks its rule, or null."""
    confidence = F.col("forecast.confidence")
    tests = [*((c, required_text(F.col(c)).isNull()) for c in ANALYSIS_TEXTS), *((f"forecast.{c}", required_text(F.col(f"forecast.{c}")).isNull()) for c in FORECAST_TEXTS), ("forecast.confidence", ~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)))]
    return F.coalesce(*(F.when(broken, F.lit(name)) for name, broken in tests))


def positions_of(positions: DataFrame, status: str = "all") -> DataFrame:
    """P-03: positions that are open, closed or any, in the order of their ids."""
    if status not in ("open", "closed", "all"):
        raise ValueError(f"status must be open, closed or all, not {status!r}")
    return (positions if status == "all" else positions.where(F.col("status") == status)).orderBy("portfolio", "id")


def portfolio_name_ok(name: Column) -> Column:
    """H-18: whether a portfolio may have this name."""
    return F.coalesce((name != "") & ~name.rlike(r"[/\\]|\.\."), F.lit(False))


def seeded(names: DataFrame, cash: float) -> DataFrame:
    """H-18: the first state of portfolios (column ``name``)."""
    return names.where(portfolio_name_ok(F.col("name"))).select("name", F.lit(cash).alias("starting_cash"), F.lit(cash).alias("cash"), F.lit(1).alias("next_id"))


def bars_between(bars: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """P-04: bars of a time range, both ends included."""
    for bound, keep in ((start_ms, lambda b: F.col("open_time") >= b), (end_ms, lambda b: F.col("open_time") <= b)):
        bars = bars if bound is None else bars.where(keep(bound))
    return bars


def selected(specs: DataFrame, **sets: list[str]) -> DataFrame:
    """P-07: specs whose columns lie in the given sets; an empty set allows all."""
    for name, allowed in sets.items():
        specs = specs.where(F.col(name).isin(allowed)) if allowed else specs
    return specs


def article_image(url: Column) -> Column:
    """P-11: whether a URL, its scheme possibly left out, is an article image."""
    return F.concat(F.when(url.startswith("//"), "https:").otherwise(""), url).startswith(ARTICLE_IMAGES)


def image_counters(refs: DataFrame) -> DataFrame:
    """A-25: one row of posts, references, those in bodies, different URLs and bytes (columns post, url, in_body, bytes)."""
    return refs.agg(F.countDistinct("post").alias("posts"), F.count("*").alias("refs"), F.count_if("in_body").alias("inserted"), F.countDistinct("url").alias("urls"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def scan_artifacts(files: DataFrame) -> DataFrame:
    """T-28, P-13: path and pattern of each known artifact of scanning in a file."""
    found = F.filter(F.array(*map(F.lit, SCAN_ARTIFACTS)), lambda p: F.contains(F.lower(F.col("text")), p))
    return files.select("path", F.explode(found).alias("pattern"))


def clean_scan(c: Column) -> Column:
    """White space of scanned text put right: single, none before closing marks or after an opening bracket."""
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, " ", " "), r"[ \t]+", " "), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(one, r"\s+([,.;:!?%)\]])", "$1"), r"\(\s+", "(")


def block_text(lines: Column) -> Column:
    """T-25: text of a block, an array of lines that are arrays of spans; empty lines go."""
    return F.array_join(F.filter(F.transform(lines, lambda spans: clean_scan(F.array_join(spans, ""))), lambda x: x != ""), "\n")


def image_manifest(figures: DataFrame, folder: str) -> DataFrame:
    """T-27, P-12: a row for each figure of a page large enough, numbered in reading order (page, block_no, left, top, right, bottom, width, height)."""
    kept = figures.where((F.col("width") >= LEAST_FIGURE) & (F.col("height") >= LEAST_FIGURE))
    n = F.row_number().over(W.Window.partitionBy("page").orderBy("block_no"))
    box = F.struct(*(F.round(c, 2).alias(c) for c in ("top", "left", "right", "bottom")))
    return kept.withColumn("figure_index", n).select(F.format_string(f"{folder}/page_%03d_fig_%d.png", "page", "figure_index").alias("image_path"), F.col("page").alias("page_number"), "figure_index", box.alias("position_in_page"), F.lit("png").alias("format"))


def summed_usage(first: Column, second: Column) -> Column:
    """A-27: input and output tokens of two usages (structs, possibly null); what is missing counts 0."""
    return F.struct(*((usage_tokens(first[c], F.lit(None)) + usage_tokens(second[c], F.lit(None))).alias(c) for c in ("input_tokens", "output_tokens")))


def dimension(score: Column, method: str) -> Column:
    """H-07: a dimension's score with its status, na without one; a score out of [0, 1] stops the query."""
    bad = F.raise_error(F.lit("a score must lie between 0 and 1")).cast("string")
    return F.struct(score.alias("score"), F.lit(method).alias("method"), F.when(score.isNull(), "na").when(score.between(0.0, 1.0), "scored").otherwise(bad).alias("status"))


def after_cutoff(post: Column, visible: Column, decided: Column) -> Column:
    """H-09: bars after a cutoff: the stated ones, else those marked visible, else none; and whether that was a fallback."""
    bars = F.coalesce(post, visible, F.array().cast("array<double>"))
    return F.struct(bars.alias("bars"), F.when(post.isNotNull(), False).when(visible.isNotNull(), True).otherwise(~decided).alias("fallback"))


def allowed_answers(answer: Column) -> Column:
    """B-16: the entries of an answer (a map) that may flow on."""
    return F.map_filter(answer, lambda k, _: k.isin(ANSWER_KEYS))


def upserted(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """K-07: a manifest with entries of equal case_id, mode and reveal replaced and the others added; null keys are equal."""
    keys = ["case_id", "mode", "reveal"]
    same = [manifest[k].eqNullSafe(entries[k]) for k in keys]
    return manifest.join(entries, same[0] & same[1] & same[2], "left_anti").unionByName(entries)


def fingerprint(values: dict[str, Column]) -> Column:
    """F-22: SHA-256 of an object's JSON, keys in order; stable in this engine."""
    return F.sha2(F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))), {"ignoreNullFields": "false"}), 256)


def evaluate_rule(bars: DataFrame, symbol: str, timeframe: str, rule: str, universe: DataFrame, reference: str | None = None) -> DataFrame:
    """R-08: one symbol's match, reason and score; relative strength ranks it within ``universe`` (symbol) and itself."""
    one = bars.sparkSession.createDataFrame([(symbol,)], "symbol string")
    ranked = universe.select("symbol").union(one).distinct() if rule == rules.RELATIVE_STRENGTH else one
    found = rules.evaluate(bars, ranked.withColumn("position", F.lit(0)), timeframe, rule, reference)
    return found.where(F.col("symbol") == symbol).drop("position")
