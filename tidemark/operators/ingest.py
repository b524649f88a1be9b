"""Ingest control: content snapshots and their differences, batches, gates, run events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def content_snapshot(files: DataFrame) -> DataFrame:
    """G-01: path and digest of each file."""
    return files.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """G-02, J-20: path and kind (added, removed, modified) of every difference of two snapshots."""
    b, a = before.select("path", F.col("digest").alias("b")), after.select("path", F.col("digest").alias("a"))
    j = b.join(a, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.select("path", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("modified").alias("kind"))


def forbidden(changed: DataFrame, exact: list[str], prefixes: list[str]) -> DataFrame:
    """P-15, G-02, H-25: changed paths that are neither allowed by name nor Markdown files under an allowed prefix."""
    allowed = F.col("path").isin(exact) if exact else F.lit(False)
    for p in prefixes:
        allowed = allowed | (F.col("path").startswith(p) & F.col("path").endswith(".md"))
    return changed.where(~allowed)


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """G-03: batches whose status changed."""
    j = before.select("batch", F.col("status").alias("was")).join(after.select("batch", F.col("status").alias("now")), "batch", "full_outer")
    return j.where(~F.col("was").eqNullSafe(F.col("now")))


def batch_order_breaks(batches: DataFrame) -> DataFrame:
    """W-13, G-04: complete batches that follow one that is not, by position in each group."""
    w = W.Window.partitionBy("grp").orderBy("position").rowsBetween(W.Window.unboundedPreceding, -1)
    open_before = F.max((F.col("status") != "complete").cast("int")).over(w)
    return batches.withColumn("open_before", open_before).where((F.col("status") == "complete") & (F.col("open_before") == 1)).drop("open_before")


def completion_proof(before: DataFrame, after: DataFrame) -> DataFrame:
    """G-05, G-06, H-35, H-37: per batch whether it may be closed, and the first condition that fails.

    Both sides: batch, status, pages, extracts, gate.  Nothing may have been written, and the gate must have passed.
    """
    b = before.select("batch", *(F.col(c).alias(f"b_{c}") for c in ("status", "pages", "extracts")))
    j = b.join(after, "batch", "left")
    why = (
        F.when(F.col("status").isNull(), "batch_missing").when(F.col("b_status") != "running", "not_running").when(~F.col("pages").eqNullSafe(F.col("b_pages")), "pages_changed")
        .when(~F.col("extracts").eqNullSafe(F.col("b_extracts")), "extracts_changed").when(~F.coalesce(F.col("gate") == "PASS", F.lit(False)), "gate_not_passed")
    )
    return j.select("batch", why.isNull().alias("proved"), why.alias("reason"))


def new_gate_results(old_lines: DataFrame, new_lines: DataFrame) -> DataFrame:
    """G-07: the last result of each batch among log lines that the old log lacks."""
    fresh = new_lines.join(old_lines.select("line"), "line", "left_anti")
    return fresh.groupBy("batch").agg(F.max_by("result", "lineno").alias("result"))


def verdict(rows: DataFrame) -> DataFrame:
    """G-08: the first reason why a recorded isolation verdict doesn't hold for the present image, or ``match``."""
    reason = F.when(F.col("recorded").isNull(), "missing").when(F.col("recorded.image") != F.col("image"), "image_changed").when(F.col("recorded.version") != F.col("version"), "version_changed").when(~F.coalesce(F.col("recorded.passed"), F.lit(False)), "not_passed").otherwise("match")
    return rows.withColumn("reason", reason)


def gate_outcome(message: Column) -> Column:
    """T-30: PASS or FAIL if the text has exactly one marker, on its last line with text; else null."""
    marker = r"GATE: (PASS|FAIL)"
    rows = F.filter(F.split(message, "\n"), lambda x: F.trim(x) != "")
    last = F.trim(F.try_element_at(rows, F.lit(-1)))
    return F.when((F.regexp_count(message, F.lit(marker)) == 1) & last.rlike(f"^{marker}$"), F.regexp_extract(last, marker, 1))


def json_objects(text_lines: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """S-19: lines that hold a JSON object, parsed; other lines go."""
    return text_lines.where(F.trim(column).rlike(r"^\{.*\}$")).withColumn("event", F.from_json(column, schema)).where("event is not null")


def final_outputs(events: DataFrame) -> DataFrame:
    """T-29: the last structured output of each stream, from whichever of its places has one."""
    value = F.coalesce("event.structured_output", "event.result", "event.text")
    return events.withColumn("v", value).where("v is not null").groupBy("stream").agg(F.max_by("v", "seq").alias("output"))


def command_states(events: DataFrame) -> DataFrame:
    """T-31, W-14: whether each command was attempted and whether its last terminal event blocked it."""
    end = F.col("kind").isin("completed", "failed", "declined")
    last = F.max_by(F.when(end, F.col("kind")), F.when(end, F.col("seq")))
    out = events.groupBy("command").agg(F.max((F.col("kind") == "started").cast("int")).alias("s"), last.alias("last"))
    return out.select("command", (F.col("s") == 1).alias("attempted"), F.coalesce(F.col("last").isin("failed", "declined"), F.lit(False)).alias("blocked"))
