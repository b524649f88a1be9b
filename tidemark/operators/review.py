"""Reviews of changed pages, and the files, answers, verdicts and states that runs begin from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wiki
from .evaluation import ANGLES

#: Where pages and generated reports lie, the pages that hold no content, what a recorded verdict must have.
WIKI = "knowledge/wiki/"
HEALTH_REPORT = r"^knowledge/wiki/health/citation-audit-[^/]*\.md$"
PLAIN_PAGES = ["index.md", "log.md", "README.md"]
VERDICT_FIELDS = ["provider", "passed", "canary", "cli_version", "system", "platform", "profile_fingerprint", "execution_identity", "recorded_at"]
#: What is left of a batch that is complete, and of one that never said.
NOTHING_LEFT, NOT_CONFIRMED = "nema", "scope nije potvrđen"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """S-13: path (below the folder) and whole text of the Markdown files of a tree, its ``health`` folders left out."""
    got = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    at = F.col("_metadata.file_path")
    top = rf"\Q{folder.rstrip('/')}/\E"
    return got.select(F.element_at(F.split(at, top, 2), -1).alias("path"), F.col("value").alias("text")).where(~F.concat(F.lit("/"), "path").contains("/health/"))


def read_portfolio(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-09: one saved portfolio; a missing file is an error, and so is JSON that doesn't parse."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def answers(files: DataFrame) -> DataFrame:
    """S-10: file, case_id and answer (a map of texts) of answer keys: an object by case, one with ``cases``, or a list.

    Another shape, an entry that is no object and one of a list without ``case_id`` stop the reading.
    """
    entry, text = "map<string,string>", F.trim("text")
    listed = F.coalesce(F.from_json(F.get_json_object("text", "$.cases"), "array<string>"), F.when(text.startswith("["), F.from_json(text, "array<string>")))
    by_case = F.when(text.startswith("{"), F.from_json(text, entry))
    object_of = lambda s: F.when(F.trim(s).startswith("{"), F.from_json(s, entry))
    of_list = F.transform(listed, lambda s: F.struct(F.try_element_at(object_of(s), F.lit("case_id")).alias("case_id"), F.map_filter(object_of(s), lambda k, _: k != "case_id").alias("answer")))
    of_map = F.transform(F.map_entries(by_case), lambda e: F.struct(e.key.alias("case_id"), object_of(e.value).alias("answer")))
    found = F.coalesce(of_list, of_map, F.raise_error(F.concat(F.lit("unsupported answer key: "), "file")))
    one = files.select("file", F.posexplode(found).alias("at", "a"))
    whole = F.when(F.col("a.answer").isNull(), F.raise_error(F.concat(F.lit("an answer must be an object: "), "file"))).when(F.col("a.case_id").isNull(), F.raise_error(F.concat(F.lit("an answer lacks case_id: "), "file"))).otherwise(F.col("a"))
    # of answers to one case the last counts
    return one.select("file", "at", whole.alias("a")).groupBy("file", F.col("a.case_id").alias("case_id")).agg(F.max_by("a.answer", "at").alias("answer"))


def health_report(path: Column) -> Column:
    """H-29: whether a page is a generated audit report."""
    return path.rlike(HEALTH_REPORT)


def primary_sources(paths: DataFrame) -> DataFrame:
    """H-29: the names that ``primary_source`` may take: the folders right below ``raw``."""
    return paths.select(F.regexp_extract("path", "^raw/([^/]+)/", 1).alias("source")).where("source <> ''").distinct()


def changed_pages(diff: DataFrame, files: DataFrame) -> DataFrame:
    """S-14: the pages that name-status lines (line) name, deleted ones and health pages left out, and whether they are there."""
    parts = F.split("line", "\t")
    path = F.get(parts, F.lit(1))
    named = diff.withColumn("path", path).where(~F.get(parts, F.lit(0)).startswith("D") & path.endswith(".md") & path.startswith(WIKI) & ~path.startswith(WIKI + "health/"))
    there = files.select("path", F.lit(True).alias("present")).distinct()
    return named.join(there, "path", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def link_repairs(files: DataFrame, existing: DataFrame) -> DataFrame:
    """T-10: links into ``raw`` that lead nowhere, with the target that climbs to the top of the tree if that file is there.

    Rows are path, target and suggestion (null: none helps).
    """
    link = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(wiki.LINK), 2)).alias("target")).where(F.col("target").rlike(r"^(\.\./)+raw/."))
    tail = F.regexp_extract("target", r"^(?:\.\./)+(.*)$", 1)
    depth = F.size(F.split("path", "/")) - 1
    climbs = ((F.length("target") - F.length("tail")) / 3).cast("int")
    placed = link.withColumn("tail", tail).withColumn("depth", depth).withColumn("left", F.col("depth") - climbs)
    # a link that climbs past the top leads out of the tree
    own = F.when(F.col("left") >= 0, F.concat_ws("/", F.slice(F.split("path", "/"), F.lit(1), F.greatest("left", F.lit(0))), F.array("tail")))
    there = existing.select("path").distinct()
    broken = placed.withColumn("own", own).join(there.withColumnRenamed("path", "own"), "own", "left_anti")
    found = broken.join(there.select(F.col("path").alias("tail"), F.lit(True).alias("there")), "tail", "left")
    return found.select("path", "target", F.when(F.col("there"), F.concat(F.expr("repeat('../', depth)"), "tail")).alias("suggestion"))


def review_findings(changed: DataFrame) -> DataFrame:
    """T-11: pr, path and code of what a change of pages (pr, status, path, text) leaves undone.

    New content pages ask for a changed index and log; content pages for a summary and key points; gap markers are shown.
    """
    path = F.col("path")
    name = F.substring_index("path", "/", -1)
    own = ~health_report(path)
    content = own & ~name.isin(PLAIN_PAGES)
    text = F.coalesce("text", F.lit(""))
    styled = content & ~path.contains("sources/")
    flags = F.array(
        F.when(styled & ~text.contains("## Summary"), "summary_missing"),
        F.when(styled & ~text.contains("## Key "), "key_points_missing"),
        F.when(own & (name != "log.md") & text.contains("WIKI_GAP"), "wiki_gap"),
    )
    of_pages = changed.where("status <> 'D'").select("pr", "path", F.explode(F.array_compact(flags)).alias("code"))
    by_pr = changed.groupBy("pr").agg(
        F.bool_or((F.col("status") == "A") & content & path.contains("knowledge/wiki")).alias("new"),
        F.bool_or(name == "index.md").alias("index"),
        F.bool_or(name == "log.md").alias("log"),
    )
    lacking = F.array_compact(F.array(*(F.when(~F.col(k), f"{WIKI}{k}.md") for k in ("index", "log"))))
    of_change = by_pr.where("new").select("pr", F.explode(lacking).alias("path"), F.lit("unchanged").alias("code"))
    return of_pages.unionByName(of_change)


def encoding_findings(files: DataFrame) -> DataFrame:
    """H-24: path and code of files (path, content) whose bytes are no UTF-8; reading goes on with the others."""
    return files.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.lit("F-EXTRACT-ENCODING").alias("code"))


def incomplete(entries: DataFrame, html: DataFrame, posts: DataFrame, manifest: DataFrame) -> DataFrame:
    """H-32: entries (by slug) that lack a saved page, a post or a row of the manifest."""
    marks = [kept.select("slug", F.lit(1 << i).alias("mark")) for i, kept in enumerate((html, posts, manifest))]
    whole = marks[0].unionByName(marks[1]).unionByName(marks[2]).groupBy("slug").agg(F.bit_or("mark").alias("marks")).where("marks = 7")
    return entries.join(whole, "slug", "left_anti")


def with_status(batches: DataFrame, changed: DataFrame, status: str, reason: str) -> DataFrame:
    """H-36: batches (id, status, pages, remaining, note), those of ``changed`` (id) set to a status with its reason."""
    left = F.lit(NOTHING_LEFT) if status == "complete" else F.coalesce(F.when(F.col("remaining") != "", F.col("remaining")), F.lit(NOT_CONFIRMED))
    new = {"status": F.lit(status), "pages": F.coalesce("pages", F.lit(0)), "remaining": left, "note": F.lit(reason)}
    hit = F.col("hit").isNotNull()
    marked = batches.join(changed.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    return marked.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).drop("hit")


def block_completed(batches: DataFrame, changed: DataFrame, reason: str) -> DataFrame:
    """H-36: batches whose change (id, after) claimed completion go back to blocked."""
    return with_status(batches, changed.where("after = 'complete'"), "blocked", reason)


def recorded_verdicts(files: DataFrame) -> DataFrame:
    """H-38: the verdicts that files (file, text) record; null where one is no object, lacks a field or has no identity object."""
    # each parsed text is exploded alone: put into the expressions above it, it would be parsed again for each field
    parsed = lambda c: F.when(F.trim(c).startswith("{"), F.from_json(c, "map<string,string>"))
    field = lambda k: F.try_element_at("v", F.lit(k))
    got = files.select("*", F.explode(F.array(parsed(F.col("text")))).alias("v"))
    got = got.select("*", F.explode(F.array(parsed(field("execution_identity")))).alias("identity"))
    has = F.coalesce(F.forall(F.array(*map(F.lit, VERDICT_FIELDS)), lambda k: F.map_contains_key("v", k)), F.lit(False))
    passed = F.coalesce(~field("passed").isin("false", "0", ""), F.lit(False))
    fields = [passed.alias(k) if k == "passed" else F.col("identity").alias(k) if k == "execution_identity" else field(k).alias(k) for k in VERDICT_FIELDS]
    return got.withColumn("verdict", F.when(has & F.col("identity").isNotNull(), F.struct(*fields, F.coalesce(field("detail"), F.lit("")).alias("detail")))).drop("v", "identity", "text")


def missing_snapshots(cases: DataFrame, existing: DataFrame) -> DataFrame:
    """B-23: case_id and angle of the snapshots that are still to be built."""
    return cases.select("case_id", F.explode(F.array(*map(F.lit, ANGLES))).alias("angle")).join(existing.select("case_id", "angle"), ["case_id", "angle"], "left_anti")


def write_scores(scores: DataFrame, folder: str) -> None:
    """K-06: scores as JSON, a folder for each case; cases written again replace their own folder only."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").json(folder)


def _stem_in_extracts(target: Column) -> Column:
    """The name, without its ending, of a link target that lies in a folder ``extracts``; else null."""
    parts = F.split(F.trim(target), "/")
    name = F.element_at(parts, -1)
    return F.when(F.array_contains(parts, "extracts"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def _index_sources(pages: DataFrame) -> DataFrame:
    """path and source of each item under ``sources:`` in the leading block, with or without ``path:``."""
    head = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n", 1)
    listed = F.regexp_extract(head, r"(?m)^sources:[ \t]*\n((?:[ \t]*-.*(?:\n|$)|[ \t]+.*(?:\n|$))*)", 1)
    return pages.select("path", F.explode(F.regexp_extract_all(listed, F.lit(r"(?m)^[ \t]*-[ \t]*(?:path:[ \t]*)?(\S+)"), F.lit(1))).alias("source"))


def taxonomy_findings(cards: DataFrame, pages: DataFrame) -> DataFrame:
    """J-15: path, code and names where extract cards and the index pages of their events and structures disagree.

    Cards are path, event, related_events, structure, related_structures and source; pages are path and text.
    ``link_missing`` and ``source_missing`` name the pages that lack a card or its source, ``unrelated`` a linked card
    that belongs elsewhere.
    """
    several = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    one = lambda c: F.filter(F.array(F.trim(F.coalesce(c, F.lit("")))), lambda x: ~x.isin("", "none"))
    under = lambda names, kind: F.transform(names, lambda x: F.concat(F.lit(f"wiki/{kind}/"), x, F.lit(".md")))
    expected = F.concat(*(under(f(F.col(c)), kind) for kind, own in (("by-event", "event"), ("by-structure", "structure")) for f, c in ((one, own), (several, f"related_{own}s"))))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    edges = cards.select("path", stem.alias("stem"), F.trim(F.coalesce("source", F.lit(""))).alias("source"), F.explode(F.array_distinct(expected)).alias("index"))
    index = pages.where(F.col("path").rlike(r"^wiki/by-(event|structure)/[^/]*\.md$"))
    links = F.concat(
        F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"), F.lit(1)),
        F.transform(F.regexp_extract_all("text", F.lit(wiki.LINK), F.lit(2)), lambda t: F.split_part(t, F.lit("#"), F.lit(1))),
    )
    linked = index.select(F.col("path").alias("index"), F.explode(links).alias("target")).select("index", _stem_in_extracts(F.col("target")).alias("stem")).where("stem IS NOT NULL").distinct()
    named = _index_sources(index).select(F.col("path").alias("index"), "source").distinct()
    lacking = lambda known, key, code: edges.join(known, ["index", key], "left_anti").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("index")), ", ").alias("names")).select("path", F.lit(code).alias("code"), "names")
    strays = linked.join(cards.select(stem.alias("stem")).distinct(), "stem", "left_semi").join(edges, ["index", "stem"], "left_anti")
    of_pages = strays.select(F.col("index").alias("path"), F.lit("unrelated").alias("code"), F.col("stem").alias("names"))
    return lacking(linked, "stem", "link_missing").unionByName(lacking(named, "source", "source_missing")).unionByName(of_pages)


def image_posts(manifest: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-16: the posts that show an image, by local path, and by URL where the local file is not to be had.

    The manifest is path, url, status and posts (an array); rows are key and post, once each.
    """
    of = lambda rows, key: rows.select(F.coalesce(key, F.lit("")).alias("key"), F.explode("posts").alias("post")).distinct()
    there = existing.select("path", F.lit(True).alias("there")).distinct()
    away = manifest.join(there, "path", "left").where(~F.coalesce(F.col("status") == "available", F.lit(False)) | F.col("there").isNull())
    return of(manifest, F.col("path")), of(away, F.col("url"))


def image_downloads(refs: DataFrame) -> DataFrame:
    """H-33: slug, seq, url and first: the place of the image of a page that is fetched, and named, for this URL.

    An image shown again takes the file of its first place; images without URL are passed over.
    """
    known = refs.where("url <> ''")
    first = known.groupBy("slug", "url").agg(F.min("seq").alias("first"))
    return known.join(first, ["slug", "url"]).select("slug", "seq", "url", "first")
