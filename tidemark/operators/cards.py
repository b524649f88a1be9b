"""Extract cards and reports: frontmatter contracts, timeframe conflicts, judge input, charts, Markdown reports."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import NAMED_TIMEFRAMES, TIME_UNITS, asset_name, chart_timeframe, shown
from ..sources.bars import violations

#: What a card's frontmatter must hold.
REQUIRED = ["source", "asset", "timeframe", "wyckoff_event", "structure", "phase", "image_path", "type", "status"]
TYPES = ["forward", "retrospective", "schematic"]
STATUSES = ["candidate", "validated", "eval-used"]
PHASES = ["A", "B", "C", "D", "E", "unknown"]
#: A named timeframe, or a number of minutes, hours or days, that stands alone (values as in ``functions.values``).
TIMEFRAME = rf"(?i)(?<![\w-])({'|'.join(NAMED_TIMEFRAMES)}|[0-9]{{1,3}}[- ]?(?:{'|'.join(TIME_UNITS)}))(?![\w-])"
#: Keys that a judge must not see, and the fields of a bar.
SENSITIVE = {"candles", "ohlcv", "post_t_candles", "future_visible", "chart", "chart_path", "chart_file", "case_dir", "case_path", "candles_path", "answer_key_path", "paths", "symbol", "cutoff", "coef_meta"}
BAR_KEYS = {"open", "high", "low", "close"}
PATH_LIKE = re.compile(r"(^|/|\\)(data/eval|case_[A-Za-z0-9_-]+|chart\.png|candles\.json)(/|\\|$)")


def card_fields(files: DataFrame) -> DataFrame:
    """path and ``fields``, a map of the leading block's plain entries (the last of a name counts)."""
    head = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n", 1)
    rows = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_]+:"))
    pairs = F.transform(rows, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("k"), F.trim(F.substr(x, F.position(F.lit(":"), x) + 1)).alias("v")))
    # the pairs and the map are exploded alone: put into the expressions above them, they would be made again for each field and each key
    split = files.select("path", F.explode(F.array(pairs)).alias("pairs"))
    keys = F.array_distinct(F.transform("pairs", lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter("pairs", lambda p: p["k"] == k), -1)["v"]
    fields = F.when(F.size(keys) == F.size("pairs"), F.map_from_entries("pairs")).otherwise(F.map_from_arrays(keys, F.transform(keys, last)))
    return split.select("path", F.explode(F.array(fields)).alias("fields"))


def card_findings(cards: DataFrame, events: list[str], structures: list[str]) -> DataFrame:
    """T-12: path and code of each rule that a card's fields break; known slugs are given."""
    get = lambda k: F.try_element_at(F.col("fields"), F.lit(k))
    text = lambda k: F.coalesce(F.trim(get(k)), F.lit(""))
    event, structure = text("wyckoff_event"), text("structure")

    def related(name: str, primary: Column, known: list[str]) -> tuple[str, Column]:
        items = F.transform(F.split(get(name), ","), lambda x: F.trim(x))
        empty = F.exists(items, lambda x: x == "")
        wrong = (primary == "none") | F.array_contains(items, primary) | (F.size(items) != F.size(F.array_distinct(items))) | F.exists(items, lambda x: ~x.isin(known))
        return f"{name}_invalid", get(name).isNotNull() & (empty | wrong)

    tests = [
        *((f"{k}_missing", text(k) == "") for k in REQUIRED),
        ("page_or_post_url_missing", (text("page") == "") & (text("post_url") == "")),
        ("type_invalid", get("type").isNotNull() & ~get("type").isin(TYPES)),
        ("status_invalid", get("status").isNotNull() & ~get("status").isin(STATUSES)),
        *((f"{k}_none", F.lower(text(k)) == "none") for k in ("asset", "timeframe")),
        ("event_unknown", (event != "") & ~event.isin([*events, "none"])),
        ("structure_unknown", (structure != "") & ~structure.isin([*structures, "none"])),
        related("related_events", event, events),
        related("related_structures", structure, structures),
        ("both_none", (event == "none") & (structure == "none")),
        ("phase_invalid", (text("phase") != "") & ~text("phase").isin(PHASES)),
    ]
    codes = F.array_compact(F.array(*(F.when(broken, F.lit(code)) for code, broken in tests)))
    return cards.select("path", F.explode(codes).alias("code"))


def timeframes(text: Column) -> Column:
    """T-16: the set of timeframes that a text names."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(TIMEFRAME), F.lit(1)), chart_timeframe))))


def timeframe_conflicts(declared: Column, evidence: Column) -> Column:
    """T-16: whether evidence that names exactly one timeframe contradicts the declared one; intraday covers minutes and hours."""
    said, own = timeframes(evidence), chart_timeframe(declared)
    only = F.get(said, F.lit(0))
    inner = lambda c: c.rlike("-(minute|hour)$")
    covered = ((own == "intraday") & inner(only)) | ((only == "intraday") & inner(own))
    return F.coalesce((F.size(said) == 1) & (own != only) & ~covered, F.lit(False))


#: How a text names the asset of a chart (a timeframe before or after it, or none), and what is no asset.
_FRAME = r"(?i:daily|weekly|monthly|yearly|intraday|\d{1,3}(?:[- ]?(?:minute|min|hour|hr|day)))"
_ASSET = r"(\$?[A-Z][A-Z0-9./&-]{0,19})"
CHARTS = [rf"(?U)(?<![\w-]){_FRAME}\s+{_ASSET}(?:\s+\d{{4}}(?:[-–]\d{{2,4}})?)?\s+chart\b", rf"(?U)(?<![\w-]){_ASSET}\s+{_FRAME}\s+chart\b", rf"(?U)\bchart\s+of\s+{_ASSET}\b"]
NO_ASSETS = ["HR", "MIN", "P&F", "PNF"]


def chart_assets(text: Column) -> Column:
    """T-16: the set of assets whose charts a text names, normalised and sorted."""
    named = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CHARTS)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(named, lambda a: ~a.isin(NO_ASSETS)), asset_name), lambda a: a != "")))


def context_conflicts(declared_timeframe: Column, declared_asset: Column, context: Column) -> Column:
    """T-16: the declared fields that a card's context contradicts, by naming exactly one timeframe or asset that is another; unknown contradicts any."""
    unknown = lambda c: F.lower(F.trim(c)) == "unknown"
    one_frame, assets, own = F.size(timeframes(context)) == 1, chart_assets(context), asset_name(declared_asset)
    frame = timeframe_conflicts(declared_timeframe, context) | (one_frame & unknown(declared_timeframe))
    asset = (F.size(assets) == 1) & (unknown(declared_asset) | ((own != "") & (own != F.get(assets, F.lit(0)))))
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in (("timeframe", frame), ("asset", asset)))))


#: What stands for one bar and for a list of bars; one is told from equal text by identity.
BAR, BARS, PATH = "[REDACTED_CANDLE]", "[REDACTED_CANDLES]", "[REDACTED_PATH]"


def _hidden(value: object) -> object:
    """What the judge sees of a value whose objects have been through ``_object``."""
    match value:
        case str() if value is not BAR and PATH_LIKE.search(value):
            return PATH
        case [_, *_] if all(v is BAR for v in value):
            return BARS
        case list():
            return list(map(_hidden, value))
    return value


def _object(pairs: list[tuple[str, object]]) -> object:
    """Called by the JSON reader for every object, inner ones first: a bar is its mark, other objects lose what is sensitive."""
    if BAR_KEYS.issubset(name for name, _ in pairs):
        return BAR
    return {name: _hidden(value) for name, value in pairs if not (name in SENSITIVE or name.endswith("_path"))}


def judge_input(c: Column) -> Column:
    """B-17: a JSON text without charts, bars, paths and names, at any depth; null if it isn't JSON."""

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return None if v is None else json.dumps(_hidden(json.loads(v, object_pairs_hook=_object)), sort_keys=True)
            except ValueError:
                return None

        return x.map(one)

    return run(c)


def chart_frame(bars: DataFrame, levels: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B-19, H-19, H-20: valid bars with their UTC time, and annotations that can be drawn: levels above 0, marks on bars that exist.

    ``levels``: symbol, price, label; ``marks``: symbol, bar_idx, label.
    """
    ok = violations(bars).where("violation is null").drop("violation").withColumn("at", F.timestamp_millis("open_time"))
    size = ok.groupBy("symbol").agg(F.count("*").alias("n"))
    line = levels.where("price > 0").select("symbol", F.lit("level").alias("kind"), F.col("price").cast("double").alias("value"), "label")
    mark = marks.join(size, "symbol").where((F.col("bar_idx") >= 0) & (F.col("bar_idx") < F.col("n"))).select("symbol", F.lit("mark").alias("kind"), F.col("bar_idx").cast("double").alias("value"), "label")
    return ok, line.unionByName(mark)


def report_markdown(groups: DataFrame) -> str:
    """H-10, F-23: the baseline table of a report; as many rows as models and efforts reach the driver."""
    n = lambda c, d=4: shown(F.col(c), d).alias(c)
    rows = groups.orderBy("model", "effort").select("model", "effort", F.col("n").cast("string"), n("mean_aggregate"), n("mean_expert_alignment"), n("mean_realized_outcome"), n("mean_total_tokens", 0), n("mean_cost_usd", 6), n("mean_roi"), "roi_basis").collect()
    head = ["Model", "Effort", "n", "Aggregate", "Expert align", "Realized outcome", "Mean tokens", "Cost (USD)", "ROI", "ROI basis"]
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])
