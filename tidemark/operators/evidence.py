"""Evidence behind extract cards: where a source lies, which pages, blocks and images bear a card's quotes.

Sources are rows of path and text; cards are rows of path, ``fields`` (a map, see ``cards.card_fields``) and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .wiki import section

#: Where sources of each kind lie, the heading of quotes, and lines that don't part two images.
SOURCES = {"book": r"^raw/book/pages/page_([0-9]{3})\.md$", "crypto": r"^raw/crypto_archive/posts/([^/]+)\.md$", "fraser": r"^raw/bruce_fraser/posts/([^/]+)\.md$"}
QUOTES = "Verbatim pasus"
FURNITURE = r"(?i)^\s*(-{3,}|_{3,}|\((click|tap)\b[^)]*(chart|version)[^)]*\))?\s*$"
LINE_END = r"\r\n|\r|\n"


def source_kind(path: Column) -> Column:
    """H-21: book, crypto or fraser by the path's form; null for others."""
    return F.coalesce(*(F.when(path.rlike(pattern), F.lit(kind)) for kind, pattern in SOURCES.items()))


def folded(path: Column) -> Column:
    """A path from the root with its dots folded away; null where it is absolute or leaves the root."""
    down = lambda at: F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1))
    walk = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda at, s: F.when(s.isin("", "."), at).when(s == "..", down(at)).otherwise(F.concat(at, F.array(s))))
    return F.when(~path.startswith("/"), F.array_join(walk, "/"))


def image_target(target: Column, source: Column) -> Column:
    """H-22: an image link as a path from the root, or its URL marked as remote; null where it leaves the root."""
    bare = F.regexp_replace(F.split_part(F.regexp_replace(F.regexp_replace(target, r"^\s+", ""), r"\s", " "), F.lit(" "), F.lit(1)), "^[<>]+|[<>]+$", "")
    steps = F.split(F.concat(F.regexp_replace(source, "[^/]*$", ""), bare), "/")
    down = lambda at: F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1))
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda at, s: F.when(s.isin("", "."), at).when(s == "..", down(at)).otherwise(F.concat(at, F.array(s))))
    return F.when(bare.rlike("^https?://"), F.concat(F.lit("(remote: "), bare, F.lit(")"))).when(~bare.startswith("/"), F.array_join(walk, "/"))


def canonical(text: Column) -> Column:
    """Text with runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quoted_paragraphs(text: Column) -> Column:
    """T-18: the quoted paragraphs of a card's section of quotes, their marks off; an empty quote or another line ends one."""
    lines = F.transform(F.split(section(text, QUOTES), LINE_END), lambda x: F.when(x.startswith(">"), F.regexp_replace(x, "^> ?", "")).otherwise(""))
    runs = F.split(F.array_join(lines, "\n"), "\n\n+")
    return F.filter(F.transform(runs, lambda x: F.regexp_replace(x, "^\n+|\n+$", "")), lambda x: x != "")


def _field(name: str) -> Column:
    return F.coalesce(F.trim(F.try_element_at("fields", F.lit(name))), F.lit(""))


def page_spans(cards: DataFrame) -> DataFrame:
    """T-14: path, ``span`` (the source page, or it and the next; null without a page) and ``code`` of a range that is neither."""
    page, stated = _field("page"), _field("page_range")
    first = F.when(page.rlike("^[0-9]+$"), page.cast("int"))
    shaped = stated.rlike("^[0-9]{1,3}-[0-9]{1,3}$")
    low, high = (F.try_to_number(F.nullif(F.regexp_extract(stated, "^([0-9]{1,3})-([0-9]{1,3})$", g), F.lit("")), F.lit("999")).cast("int") for g in (1, 2))
    nexts = (low == first) & (high == first + 1)
    code = F.when(first.isNull() | (stated == ""), None).when(~shaped, "page_range_form").when(~nexts, "page_range_reach")
    span = F.when(first.isNotNull() & (stated == ""), F.array(first)).when(shaped & nexts, F.array(low, high))
    return cards.select("path", span.alias("span"), code.alias("code"))


def source_findings(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """T-13: path and code of cards whose source is no file of a known kind, or doesn't bear the stated page or URL."""
    c = cards.select("path", _field("source").alias("source"), _field("page").alias("page"), _field("post_url").alias("post_url"), F.map_contains_key("fields", F.lit("page")).alias("p"), F.map_contains_key("fields", F.lit("page_range")).alias("r"), F.map_contains_key("fields", F.lit("post_url")).alias("u")).where("source <> ''")
    known = sources.select(F.col("path").alias("source"), F.nullif(F.regexp_extract("text", r"(?m)^URL:\s*(\S+)\s*$", 1), F.lit("")).alias("url"), F.lit(True).alias("stands"))
    kind, book = source_kind(F.col("source")), source_kind(F.col("source")) == "book"
    paged = F.coalesce(F.when(F.col("page").rlike("^[0-9]+$"), F.col("page").cast("int")) == F.regexp_extract("source", SOURCES["book"], 1).try_cast("int"), F.lit(False))
    code = F.when(F.col("source").startswith("/"), F.array(F.lit("source_absolute"))).when(kind.isNull(), F.array(F.lit("source_place"))).when(F.col("stands").isNull(), F.array(F.lit("source_missing")))
    code = code.when(book, F.array(F.when(~paged, F.lit("book_page")), F.when(F.col("u"), F.lit("book_post_url"))))
    code = code.otherwise(F.array(F.when(F.col("p") | F.col("r"), F.lit("post_page")), F.when(~F.coalesce(F.col("post_url") == F.col("url"), F.lit(False)), F.lit("post_url"))))
    return c.join(known, "source", "left").select("path", F.explode(F.array_compact(code)).alias("code"))


def quote_findings(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """T-18: path and code of cards without quotes, with quotes that their source or stated pages lack, or with bad pages.

    Cards whose source is missing or of no kind are left to ``source_findings``.
    """
    known = sources.select(F.col("path").alias("place"), F.col("text").alias("source_text"))
    own = cards.withColumn("source", _field("source")).join(known.select(F.col("place").alias("source")), "source", "left_semi").where(source_kind(F.col("source")).isNotNull())
    ranged = (source_kind(F.col("source")) == "book") & (_field("page_range") != "")
    c = own.join(page_spans(own), "path").withColumn("ranged", ranged).withColumn("quotes", quoted_paragraphs(F.col("text")))
    early = c.where(F.col("ranged") & F.col("code").isNotNull()).select("path", "code")
    c = c.where(~F.col("ranged") | F.col("span").isNotNull())
    places = F.when(F.col("ranged"), F.transform("span", lambda n: F.format_string("raw/book/pages/page_%03d.md", n))).otherwise(F.array("source"))
    met = c.select("path", "quotes", F.posexplode(places).alias("at", "place")).join(known, "place", "left")
    whole = met.groupBy("path").agg(F.first("quotes").alias("quotes"), F.bool_or(F.col("source_text").isNull()).alias("gap"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "source_text"))), lambda s: s["source_text"]), "\n").alias("t"))
    text = F.when(F.col("gap"), F.lit("")).otherwise(canonical(F.col("t")))
    absent = F.exists("quotes", lambda q: ~F.contains(text, canonical(q)))
    codes = F.array_compact(F.array(F.when(F.col("gap"), F.lit("range_page_missing")), F.when(F.size("quotes") == 0, F.lit("quote_missing")).when(absent, F.lit("quote_absent"))))
    return early.unionByName(whole.select("path", F.explode(codes).alias("code")))


def evidence_blocks(sources: DataFrame) -> DataFrame:
    """W-09: path, block (from 0), heading, images and body of each group of images and the lines that follow it.

    Images apart by blank lines, rules or click lines are one group; a heading or other text ends it.
    """
    head, links = F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*$", 1), F.regexp_extract_all("line", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    row = sources.select("path", F.posexplode(F.split("text", LINE_END)).alias("at", "line"))
    row = row.withColumn("head", F.nullif(head, F.lit(""))).withColumn("links", F.when(F.col("head").isNull(), links).otherwise(F.array().cast("array<string>")))
    row = row.withColumn("is_image", F.size("links") > 0).withColumn("prose", F.col("head").isNull() & ~F.col("is_image") & ~F.col("line").rlike(FURNITURE))
    upto = W.Window.partitionBy("path").orderBy("at").rowsBetween(W.Window.unboundedPreceding, 0)
    before = W.Window.partitionBy("path").orderBy("at").rowsBetween(W.Window.unboundedPreceding, -1)
    row = row.withColumn("part", F.count("head").over(upto)).withColumn("heading", F.last("head", True).over(upto)).withColumn("said", F.sum(F.col("prose").cast("int")).over(upto))
    here = F.struct("part", "said")
    row = row.withColumn("new", F.col("is_image") & ~F.coalesce(F.last(F.when(F.col("is_image"), here), True).over(before) == here, F.lit(False)))
    row = row.withColumn("group", F.sum(F.col("new").cast("int")).over(upto)).withColumn("own", F.last(F.when(F.col("new"), F.col("part")), True).over(upto) == F.col("part"))
    row = row.where(F.col("own") & F.col("head").isNull())
    lines = F.array_sort(F.collect_list(F.struct("at", "links", "line")))
    got = row.groupBy("path", "group").agg(F.coalesce(F.first("heading"), F.lit("")).alias("heading"), lines.alias("rows"), F.max(F.when(F.col("is_image"), F.col("at"))).alias("until"))
    images = F.array_compact(F.transform(F.flatten(F.transform("rows", lambda x: x["links"])), lambda t: image_target(t, F.col("path"))))
    body = F.array_join(F.transform(F.filter("rows", lambda x: x["at"] > F.col("until")), lambda x: x["line"]), "\n")
    got = got.select("path", "group", "heading", images.alias("images"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body")).where(F.size("images") > 0)
    return got.withColumn("block", F.row_number().over(W.Window.partitionBy("path").orderBy("group")) - 1).drop("group")


def image_candidates(blocks: DataFrame) -> DataFrame:
    """W-11: blocks with ``candidates``, their own images and the next block's if it has their heading."""
    nxt = F.lead(F.struct("heading", "images")).over(W.Window.partitionBy("path").orderBy("block"))
    more = F.when(nxt["heading"] == F.col("heading"), nxt["images"]).otherwise(F.array().cast("array<string>"))
    return blocks.withColumn("candidates", F.array_distinct(F.concat("images", more)))


def quote_blocks(cards: DataFrame, blocks: DataFrame) -> DataFrame:
    """T-17: for each card (path, source, text) whose quotes all stand in exactly one block of its source: that block."""
    c = cards.select("path", "source", quoted_paragraphs(F.col("text")).alias("quotes")).where(F.size("quotes") > 0)
    b = blocks.select(F.col("path").alias("source"), "block", canonical(F.col("body")).alias("body"))
    held = c.join(b, "source").where(F.forall("quotes", lambda q: F.contains(F.col("body"), canonical(q))))
    return held.groupBy("path").agg(F.count("*").alias("n"), F.min("block").alias("block")).where("n = 1").drop("n")


#: Fixed value: what a card without an image says.
NO_IMAGE = "bez slike"


def post_images(posts: DataFrame) -> DataFrame:
    """(key, post): each Markdown image of each post, as a path from the root, once."""
    refs = F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    each = posts.select(F.col("path").alias("post"), F.explode(refs).alias("ref"))
    return each.select(image_target(F.col("ref"), F.col("post")).alias("key"), "post").where("key is not null").distinct()


def card_image_findings(cards: DataFrame, files: DataFrame, book: DataFrame, posts: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """J-16: path and code of cards whose image is none, no file, or not their source's.

    ``files``: path; ``book``: image_path, page_number; ``posts``: path, text, of posts whose own Markdown shows
    their images; ``local`` and ``remote``: key (path or URL) and post, as ``review.image_posts`` gives them.
    A card meets one row of each by its image, or by its image and source.
    """
    c = cards.select("path", "fields", _field("image_path").alias("image"), _field("source").alias("source"), _field("page").alias("page")).where("image <> ''").withColumn("kind", source_kind(F.col("source")))
    c = c.withColumns({"away": F.lower("image").startswith("(remote"), "url": F.trim(F.regexp_extract("image", r"^\(remote:\s*(https?://[^)]+)\)$", 1)), "at": folded(F.col("image"))})
    pairs = lambda df, image, flag: df.select(F.col("key").alias(image), F.col("post").alias("source"), F.lit(True).alias(flag)).distinct()
    c = c.join(files.select(F.col("path").alias("at"), F.lit(True).alias("stands")).distinct(), "at", "left").join(book.groupBy(F.col("image_path").alias("image")).agg(F.max("page_number").alias("of_page")), "image", "left")
    c = c.join(pairs(remote, "url", "sent"), ["url", "source"], "left").join(pairs(local, "image", "mapped"), ["image", "source"], "left").join(pairs(post_images(posts), "image", "shown"), ["image", "source"], "left")
    c = c.join(page_spans(cards).select("path", F.col("span").isNotNull().alias("paged"), F.col("code").alias("span_code")), "path", "left")
    here = F.coalesce(F.when(F.col("page").rlike("^[0-9]+$"), F.col("page").cast("int")) == F.col("of_page"), F.lit(False)) & F.coalesce("paged", F.lit(False))
    own = F.when(F.col("kind") == "book", here).when(F.col("kind") == "crypto", F.coalesce("shown", F.lit(False))).when(F.col("kind") == "fraser", F.coalesce("mapped", F.lit(False))).otherwise(True)
    sent = (F.coalesce(F.col("kind") == "fraser", F.lit(False))) & F.coalesce("sent", F.lit(False))
    stands = F.coalesce("stands", F.lit(False))
    code = F.when(F.lower("image") == NO_IMAGE, "image_none").when(F.col("away"), F.when(~sent, "image_provenance")).when(F.col("image").startswith("/"), "image_absolute").when(~stands, "image_missing").when(~own, "image_provenance")
    span = F.when((F.col("kind") == "book") & ~F.col("away") & (F.lower("image") != NO_IMAGE) & stands, F.col("span_code"))
    return c.select("path", F.explode(F.array_compact(F.array(span, code))).alias("code"))
