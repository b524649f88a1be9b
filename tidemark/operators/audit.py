"""The citation audit as a whole: every issue of every file with its message, and the report over them.

Each check is a join of citations with what they name; no file is read by a loop.  Issues carry the place of
their check and citation, so equal ones are told apart from repeats by the first, as a file is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import wiki

#: What the issues say.
MISSING_RAW = "cited raw path does not exist"
IMAGE_ONLY = "cited raw page contains only markdown image references and no prose"
BOUNDARY = "cited book page ends with uppercase heading only: {}; check next page for supporting prose"
UNLISTED = "inline citation has no matching frontmatter source(s): "
UNCITED = "frontmatter source is not cited inline on this page"
RANGE_TARGET = "range citation should link to first page {}, got {}"
RANGE_FILES = "range citation points across missing raw page(s): "
RANGE_LISTED = "range citation page(s) absent from frontmatter: "
NOT_FOUND = "blockquote phrase not found in cited raw page: {}"
#: Fixed value: a top folder of files that the audit leaves alone.
REPORTS = "health"
LEAST_QUOTE = 6


def auditable(files: DataFrame, top: str = "wiki/") -> DataFrame:
    """S-13, H-29: the files under ``top`` but for generated reports."""
    return files.where(F.col("path").startswith(top) & ~F.col("path").startswith(f"{top}{REPORTS}/") & F.col("path").endswith(".md"))


def _said(template: str, *values: Column) -> Column:
    parts = template.split("{}")
    return F.concat(*(x for k, p in enumerate(parts) for x in ([F.lit(p)] + ([values[k]] if k < len(values) else []))))


def _quoted(text: Column) -> Column:
    """A text between quotation marks, double ones where it has single ones only."""
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    inner = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.when(double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'")))


def citations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inline, frontmatter) citations with ``named``: the label of an inline one, the path of a listed one."""
    inline = wiki.inline_citations(files).withColumn("named", F.col("label"))
    front = wiki.frontmatter_sources(files).withColumn("named", F.col("raw_path"))
    return inline, front


def _content(inline: DataFrame, front: DataFrame, raw: DataFrame) -> DataFrame:
    """T-07 with messages: missing files, pages of images only, pages that end at a heading."""
    none = F.array().cast("array<int>")
    cited = inline.select("path", "lineno", "ordinal", F.lit(1).alias("kind"), "named", "raw_path", "pages").unionByName(front.where(F.col("raw_path").startswith("raw/")).select("path", "lineno", F.lit(0).alias("ordinal"), F.lit(0).alias("kind"), "named", "raw_path", none.alias("pages")))
    j = cited.join(wiki.raw_kinds(raw).withColumnRenamed("path", "raw_path").withColumn("there", F.lit(True)), "raw_path", "left")
    goes_on = F.coalesce((F.col("kind") == 1) & (wiki.page_of(F.col("raw_path")) < F.array_max("pages")), F.lit(False))
    code = F.when(F.col("there").isNull(), "missing_raw").when(F.col("image_only"), "image_only").when(F.col("tail").isNotNull() & ~goes_on, "section_boundary")
    detail = F.when(F.col("there").isNull(), MISSING_RAW).when(F.col("image_only"), IMAGE_ONLY).otherwise(_said(BOUNDARY, _quoted(F.col("tail"))))
    return j.select("path", "lineno", F.struct(F.lit(0), "kind", "lineno", "ordinal").alias("seq"), "named", "raw_path", code.alias("code"), detail.alias("detail")).where("code is not null")


def _per_citation(inline: DataFrame, missing: DataFrame, code: str, said: str, check: int, ordered: bool) -> DataFrame:
    """One issue for each citation (path, lineno, ordinal) with the paths that it lacks, sorted or in page order."""
    listed = F.collect_list(F.struct("nth", "expected"))
    names = F.array_sort(F.transform(listed, lambda x: x["expected"])) if ordered else F.transform(F.array_sort(listed), lambda x: x["expected"])
    each = missing.groupBy("path", "lineno", "ordinal").agg(names.alias("names"))
    j = inline.join(each, ["path", "lineno", "ordinal"])
    return j.select("path", "lineno", F.struct(F.lit(check), F.lit(1).alias("kind"), "lineno", "ordinal").alias("seq"), "named", "raw_path", F.lit(code).alias("code"), F.concat(F.lit(said), F.array_join("names", ", ")).alias("detail"))


def _expected(inline: DataFrame) -> DataFrame:
    ranged = (F.size("pages") > 0) & F.col("raw_path").startswith(wiki.PAGE_PREFIX)
    paths = F.when(ranged, F.transform("pages", wiki.page_path)).otherwise(F.array("raw_path"))
    return inline.select("path", "lineno", "ordinal", F.posexplode(paths).alias("nth", "expected"), F.size("pages").alias("n_pages"))


def _listing(inline: DataFrame, front: DataFrame, raw: DataFrame) -> DataFrame:
    """J-12 and T-08 with messages: parity of citations and sources, and ranges."""
    each = _expected(inline)
    named = front.select("path", F.col("raw_path").alias("expected")).distinct()
    unlisted = each.join(named, ["path", "expected"], "left_anti")
    uncited = front.join(inline.select("path", "raw_path").distinct(), ["path", "raw_path"], "left_anti")
    no_file = each.where("n_pages > 1").join(raw.select(F.col("path").alias("expected")), "expected", "left_anti")
    ranged = inline.where(F.size("pages") > 1)
    first = F.when(F.col("raw_path").startswith(wiki.PAGE_PREFIX), wiki.page_path(F.get("pages", F.lit(0)))).otherwise(F.col("raw_path"))
    target = ranged.withColumn("first", first).where("raw_path <> first")
    place = lambda check, kind, ordinal: F.struct(F.lit(check), F.lit(kind).alias("kind"), "lineno", ordinal.alias("ordinal")).alias("seq")
    return (
        _per_citation(inline, unlisted, "frontmatter_missing", UNLISTED, 1, True)
        .unionByName(uncited.select("path", "lineno", place(2, 0, F.lit(0)), "named", "raw_path", F.lit("inline_missing").alias("code"), F.lit(UNCITED).alias("detail")))
        .unionByName(target.select("path", "lineno", place(3, 1, F.col("ordinal")), "named", "raw_path", F.lit("range_target").alias("code"), _said(RANGE_TARGET, F.col("first"), F.col("raw_path")).alias("detail")))
        .unionByName(_per_citation(inline, no_file, "range_missing_raw", RANGE_FILES, 4, False))
        .unionByName(_per_citation(inline, unlisted.where("n_pages > 1"), "range_missing_frontmatter", RANGE_LISTED, 5, False))
    )


def _quotes(files: DataFrame, inline: DataFrame, raw: DataFrame, literal: bool) -> DataFrame:
    """T-04 to T-06 with messages: quotes of six words or more that their file lacks, or whose file is missing."""
    normal = wiki.alnum if literal else wiki.normalised
    blocks = wiki.quote_blocks(files).where(F.size(F.split(normal(F.col("quote")), " ")) >= LEAST_QUOTE)
    sourced = wiki.quote_sources(blocks, inline)
    place = F.struct(F.lit(6), F.lit(1).alias("kind"), F.col("start").alias("lineno"), F.lit(0).alias("ordinal")).alias("seq")
    gone = sourced.join(raw.select(F.col("path").alias("raw_path")), "raw_path", "left_anti").select("path", F.col("start").alias("lineno"), place, F.col("label").alias("named"), "raw_path", F.lit("missing_raw").alias("code"), F.lit(MISSING_RAW).alias("detail"))
    lost = sourced.join(wiki.found_quotes(sourced, raw, literal=literal).where("not found").select("path", "start"), ["path", "start"])
    words = wiki.phrase(F.col("quote"))
    if not literal:
        lost = lost.where(words != "")  # a quote of figures only has no words to look for
    return gone.unionByName(lost.select("path", F.col("start").alias("lineno"), place, F.col("label").alias("named"), "raw_path", F.lit("quote_not_found").alias("code"), _said(NOT_FOUND, _quoted(words)).alias("detail")))


def issues(files: DataFrame, raw: DataFrame, literal: bool = False) -> DataFrame:
    """H-28, A-22: file, line, code, severity, citation, raw_path, detail of all checks, each kind of issue of a line once.

    ``files`` and ``raw`` are tables of (path, text).  If ``literal``, quotes must stand in their file to the letter, those of figures too (see ``wiki.found_quotes``).
    """
    inline, front = citations(files)
    all_ = _content(inline, front, raw).unionByName(_listing(inline, front, raw)).unionByName(_quotes(files, inline, raw, literal))
    first = W.Window.partitionBy("code", "path", "lineno", "raw_path", "detail").orderBy("seq")
    kept = all_.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return kept.select(F.col("path").alias("file"), F.col("lineno").alias("line"), "code", wiki.severity(F.col("code")).alias("severity"), F.col("named").alias("citation"), "raw_path", "detail", "seq")


def in_order(found: DataFrame) -> DataFrame:
    """O-06: by file, line and code, then as they were found."""
    return found.orderBy("file", "line", "code", "seq").drop("seq")


def report(files: DataFrame, found: DataFrame) -> DataFrame:
    """T-09: one row of counts: files, files with flags, flags, hard and warning flags, and flags by code and by severity (maps)."""
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    counts = found.groupBy("code", "severity").agg(F.count("*").alias("n"))  # as many rows as there are codes
    codes = counts.agg(by("code").alias("summary_by_code"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_flags"), F.coalesce(F.sum(F.when(F.col("severity") == "HARD", F.col("n"))), F.lit(0)).alias("hard_flags"), F.coalesce(F.sum(F.when(F.col("severity") == "WARNING", F.col("n"))), F.lit(0)).alias("warning_flags"))
    severities = counts.groupBy("severity").agg(F.sum("n").alias("n")).agg(by("severity").alias("summary_by_severity"))
    checked = files.agg(F.count("*").alias("files_checked"))
    flagged = found.agg(F.countDistinct("file").alias("files_with_flags"))
    # single rows
    return checked.crossJoin(flagged).crossJoin(codes).crossJoin(severities)


def exit_code(found: DataFrame) -> int:
    """1 if any issue is hard, else 0."""
    return int(bool(found.where("severity = 'HARD'").take(1)))
