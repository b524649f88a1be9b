"""Signals and analyses as append-only logs by month: write, list, get and review, each a Spark job over the log's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import normalize_symbol
from ..functions.values import month_of
from . import ledgers, records
from .backtest import filtered_signals

SIGNAL = "signal_id string, logged_at string, symbol string, timeframe string, signal_type string, entry_zone array<double>, invalidation double, target_zone array<double>, tactical_quality string, evidence array<string>, phase_identified string, wiki_pages_cited array<string>"
FORECAST = "direction string, trigger string, invalidation string, confidence double"
ANALYSIS = f"analysis_id string, logged_at string, symbol string, timeframe string, model string, effort string, narrative string, structure string, phase string, forecast struct<{FORECAST}>, chart_path string"
REVIEW = "reviewed_at string, realized_direction string, hit_trigger boolean, note string"
PLACE = ["month", "place", "line"]


def _stamped(df: DataFrame, time: str, of: str | None) -> DataFrame:
    """Times as UTC text with a Z, now where there is none; ids where they are missing."""
    at = F.coalesce(F.try_to_timestamp(time), F.when(F.col(time).isNull(), F.current_timestamp()))
    df = df.withColumn(time, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return df if of is None else df.withColumn(of, F.coalesce(of, F.uuid()) if of in df.columns else F.uuid())


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, null where they are missing."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def _refuse(df: DataFrame, what: str) -> None:
    """Nothing is written if any row breaks a rule."""
    bad = df.where("problem is not null").select("problem").take(1)
    if bad:
        raise ValueError(f"{what} breaks a rule: {bad[0]['problem']}")


def _append(df: DataFrame, folder: str, time: str) -> None:
    """K-01 to K-03: JSON lines, nulls written, a folder for each month of ``time``."""
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"), month_of(F.col(time)).alias("month"))
    lines.write.mode("append").partitionBy("month").text(folder)


class SignalLog:
    """B-21: a log of signals."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def append(self, signals: DataFrame) -> None:
        """Write new signals; one that breaks a rule of K-01 keeps all of them out."""
        given = signals if "logged_at" in signals.columns else signals.withColumn("logged_at", F.lit(None).cast("string"))
        readable = F.col("logged_at").isNull() | F.try_to_timestamp("logged_at").isNotNull()
        checked = ledgers.signal_problem(given.withColumn("logged_at", F.when(F.col("logged_at").isNull(), F.lit("1970-01-01T00:00:00Z")).otherwise(F.col("logged_at")))).select("problem")
        _refuse(checked, "a signal")
        stamped = _stamped(given.where(readable), "logged_at", "signal_id").withColumn("symbol", normalize_symbol(F.col("symbol")))
        _append(_shaped(stamped, SIGNAL), self.folder, "logged_at")

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return records.read_signals(self.spark, self.folder, SIGNAL, start, end)

    def list(self, symbol: str | None = None, signal_type: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """P-01, O-05: signals of a symbol, a type and a time range, by their time as text."""
        return filtered_signals(self.read(start, end), symbol, signal_type).orderBy("logged_at", *PLACE).drop(*PLACE)

    def get(self, signal_id: str) -> DataFrame:
        """P-06: the signal of an id, of the newest month the first line; no row if there is none."""
        return self.read().where(F.col("signal_id") == signal_id).orderBy(F.col("month").desc(), "place", "line").limit(1).drop(*PLACE)


class JournalLog:
    """B-22: a journal of analyses and their reviews; a broken line anywhere stops every reading of it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def append(self, analyses: DataFrame) -> None:
        """Write new analyses, texts trimmed; one that breaks a rule of K-02 keeps all of them out."""
        given = analyses if "logged_at" in analyses.columns else analyses.withColumn("logged_at", F.lit(None).cast("string"))
        late = F.when(F.col("logged_at").isNotNull() & F.try_to_timestamp("logged_at").isNull(), "logged_at")
        _refuse(given.select(F.coalesce(records.analysis_problem(), late).alias("problem")), "an analysis")
        trimmed = given.withColumns({c: records.required_text(F.col(c)) for c in records.ANALYSIS_TEXTS})
        trimmed = trimmed.withColumn("forecast", F.struct(*(records.required_text(F.col(f"forecast.{c}")).alias(c) for c in records.FORECAST_TEXTS), F.col("forecast.confidence").cast("double").alias("confidence")))
        _append(_shaped(_stamped(trimmed, "logged_at", "analysis_id"), ANALYSIS).withColumn("review", F.lit(None).cast("string")), self.folder, "logged_at")

    def review(self, reviews: DataFrame) -> int:
        """K-03: write reviews (analysis_id, realized_direction, hit_trigger, note) of analyses that exist; how many those were."""
        known = reviews.join(self._read()[0].select("analysis_id").distinct(), "analysis_id", "left_semi")
        texts = ("realized_direction", "note")
        broken = F.coalesce(*(F.when(records.required_text(F.col(c)).isNull(), c) for c in texts), F.when(F.col("hit_trigger").isNull(), "hit_trigger"))
        _refuse(known.select(broken.alias("problem")), "a review")
        given = known if "reviewed_at" in known.columns else known.withColumn("reviewed_at", F.lit(None).cast("string"))
        stamped = _stamped(given.withColumns({c: records.required_text(F.col(c)) for c in texts}), "reviewed_at", None).cache()
        n = stamped.count()
        _append(stamped.select(F.lit("review").alias("type"), "analysis_id", F.struct("reviewed_at", "realized_direction", "hit_trigger", "note").alias("review"), "reviewed_at").select("type", "analysis_id", "review", "reviewed_at"), self.folder, "reviewed_at")
        stamped.unpersist()
        return n

    def _read(self, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
        return records.read_journal(self.spark, self.folder, ANALYSIS, REVIEW, start, end)

    def _with_reviews(self, analyses: DataFrame, reviews: DataFrame) -> DataFrame:
        """J-07, A-14: the latest review by time, of equal times the one written last."""
        order = F.struct(F.try_to_timestamp("reviewed_at"), *PLACE)
        latest = reviews.groupBy("analysis_id").agg(F.max_by(F.struct("reviewed_at", "realized_direction", "hit_trigger", "note"), order).alias("review"))
        return analyses.join(latest, "analysis_id", "left")

    def list(self, symbol: str | None = None, model: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """P-02, O-05: analyses of a symbol, a model and a time range with their latest review, by their time as text."""
        analyses, reviews = self._read(start, end)
        at = F.try_to_timestamp("logged_at")
        for wanted, keep in ((symbol, F.col("symbol") == symbol), (model, F.col("model") == model), (start, lambda: at >= F.lit(records.utc_time(start))), (end, lambda: at <= F.lit(records.utc_time(end)))):
            if wanted is not None:
                analyses = analyses.where(keep() if callable(keep) else keep)
        return self._with_reviews(analyses, reviews).orderBy("logged_at", *PLACE).drop(*PLACE)

    def get(self, analysis_id: str) -> DataFrame:
        """P-06: the analysis of an id that was written last, with its latest review; no row if there is none."""
        analyses, reviews = self._read()
        last = analyses.where(F.col("analysis_id") == analysis_id).orderBy(*(F.col(c).desc() for c in PLACE)).limit(1)
        return self._with_reviews(last, reviews.where(F.col("analysis_id") == analysis_id)).drop(*PLACE)
