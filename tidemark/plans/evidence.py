"""Queries over the evidence of extract cards; posts and cards are made from documents, pages from benchmark items."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, ocr
from ..sources import published
from .common import scratch, table


def _id() -> Column:
    return F.col("doc_id")


def _post(i: Column) -> Column:
    return F.concat(F.lit("raw/crypto_archive/posts/d"), i.cast("string"), F.lit(".md"))


def _posts(spark: SparkSession, d: str) -> DataFrame:
    """A post for each document: of five lines one is a heading, two hold images, the others text, a rule or a click line."""
    lines = F.split(F.regexp_replace("text", r"[#!>\r]", "."), "\n")

    def line(x: Column, j: Column) -> Column:
        n = j.cast("string")
        image = lambda at: F.concat(F.lit("![c]("), F.lit(at), n, F.lit(".png)"))
        third = F.when(_id() % 2 == 0, F.lit("(Click for a larger chart)")).otherwise(x)
        return F.when(j % 5 == 0, F.concat(F.lit("## H"), n)).when(j % 5 == 1, image("../img/")).when(j % 5 == 2, third).when(j % 5 == 3, image("http://h/")).otherwise(F.when(_id() % 3 == 0, F.lit("---")).otherwise(x))

    body = F.array_join(F.transform(lines, line), "\n")
    return table(spark, d, "documents").select("doc_id", lines.alias("lines"), _post(_id()).alias("path"), F.concat(F.lit("URL: http://x/"), _id().cast("string"), F.lit("\n"), body).alias("text"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Book pages of three digits from benchmark items; one of nine is missing."""
    return table(spark, d, "benchmark").where("item_id < 1000 and item_id % 9 <> 4").select(F.format_string("raw/book/pages/page_%03d.md", "item_id").alias("path"), F.col("text"))


def w09_evidence_blocks(spark: SparkSession, d: str) -> DataFrame:
    return evidence.evidence_blocks(_posts(spark, d)).select("path", "block", "heading", F.array_join("images", ",").alias("images"), F.md5("body").alias("body"))


def w11_image_candidates(spark: SparkSession, d: str) -> DataFrame:
    got = evidence.image_candidates(evidence.evidence_blocks(_posts(spark, d)))
    return got.select("path", "block", F.array_join("candidates", ",").alias("candidates"))


def t17_quote_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A card for each post; it quotes the fifth line, or the third too where the post's number is a multiple of four less one."""
    posts = _posts(spark, d)
    quote = lambda k: F.concat(F.lit("> "), F.get("lines", F.lit(k)), F.lit("\n"))
    text = F.concat(F.lit("## Verbatim pasus\n"), quote(4), F.when(_id() % 4 == 3, F.concat(F.lit(">\n"), quote(2))).otherwise(F.lit("")), F.lit("## End\n"))
    cards = posts.where(F.size("lines") > 4).select(F.concat(F.lit("card/"), _id().cast("string")).alias("path"), F.col("path").alias("source"), text.alias("text"))
    return evidence.quote_blocks(cards, evidence.evidence_blocks(posts))


def t13_source_findings(spark: SparkSession, d: str) -> DataFrame:
    k, s, page = _id() % 12, _id().cast("string"), F.format_string("raw/book/pages/page_%03d.md", _id() % 40)
    source = F.when(k == 0, "/abs/x.md").when(k == 1, "raw/other/x.md").when(k == 2, F.concat(F.lit("raw/crypto_archive/posts/none"), s, F.lit(".md"))).when(k.isin(3, 4, 5, 11), page).when(k == 9, "").when(k == 10, "raw/bruce_fraser/posts/none.md").otherwise(_post(_id()))
    url = F.when(k == 7, F.lit("http://y")).when(k == 5, F.lit("http://x")).when(k.isin(6, 8), F.concat(F.lit("http://x/"), s))
    page_of = F.when(k.isin(3, 5), (_id() % 40).cast("string")).when(k == 4, (_id() % 40 + 1).cast("string")).when(k == 11, F.lit("ten")).when(k == 6, F.lit("1"))
    fields = F.map_filter(F.map_from_arrays(F.array(F.lit("source"), F.lit("page"), F.lit("post_url")), F.array(source, page_of, url)), lambda _, v: v.isNotNull())
    cards = table(spark, d, "documents").select(F.concat(F.lit("card/"), s).alias("path"), fields.alias("fields"))
    return evidence.source_findings(cards, _posts(spark, d).select("path", "text").unionByName(_pages(spark, d)))


def t14_page_spans(spark: SparkSession, d: str) -> DataFrame:
    k, n = _id() % 6, (_id() % 900)
    a, b, c = (x.cast("string") for x in (n, n + 1, n + 2))
    page = F.when(k == 3, F.lit("x")).when(k == 5, F.lit("")).otherwise(a)
    stated = F.when(k == 0, F.lit("")).when(k == 2, F.concat(a, F.lit("-"), c)).when(k == 4, a).otherwise(F.concat(a, F.lit("-"), b))
    cards = table(spark, d, "documents").select(F.concat(F.lit("card/"), _id().cast("string")).alias("path"), F.create_map(F.lit("page"), page, F.lit("page_range"), stated).alias("fields"))
    return evidence.page_spans(cards).select("path", F.array_join("span", ",").alias("span"), "code")


def t18_quote_findings(spark: SparkSession, d: str) -> DataFrame:
    """Cards quote their post's first text line, that and more, a stretch of the page after theirs, or nothing."""
    k, n = _id() % 4, _id() % 40
    docs = _posts(spark, d).join(table(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("next")), n + 1 == F.col("item_id"), "left")
    quote = F.when(k == 2, F.substring(F.regexp_replace(F.coalesce("next", F.lit("none")), r"\s+", " "), 11, 50)).when(k == 1, F.concat(F.coalesce(F.get("lines", F.lit(4)), F.lit("URL:")), F.lit(" qqzzqq"))).otherwise(F.lit("URL:  http://x/"))
    text = F.concat(F.lit("## Verbatim pasus\n"), F.when(k == 3, F.lit("no quote")).otherwise(F.concat(F.lit("> "), quote)), F.lit("\n\n## End\n"))
    page, none = F.format_string("raw/book/pages/page_%03d.md", n), F.lit("")
    stated = F.when(_id() % 8 == 2, F.concat(n.cast("string"), F.lit("-"), (n + 1).cast("string"))).when(_id() % 16 == 6, F.lit("1-9")).otherwise(none)
    fields = F.create_map(F.lit("source"), F.when(k == 2, page).otherwise(F.col("path")), F.lit("page"), F.when(k == 2, n.cast("string")).otherwise(none), F.lit("page_range"), F.when(k == 2, stated).otherwise(none))
    cards = docs.select(F.concat(F.lit("card/"), _id().cast("string")).alias("path"), fields.alias("fields"), text.alias("text"))
    return evidence.quote_findings(cards, _posts(spark, d).select("path", "text").unionByName(_pages(spark, d)))


LINES = """x AS (SELECT doc_id, string_split(regexp_replace(text, '[#!>\\r]', '.', 'g'), chr(10)) AS lines FROM documents),
  l AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS j FROM x),
  g AS (SELECT doc_id, j // 5 AS m, count(*) FILTER (j % 5 = 1) AS i1, count(*) FILTER (j % 5 = 3) AS i3, max(CASE WHEN doc_id % 2 = 0 THEN '(Click for a larger chart)' ELSE x END) FILTER (j % 5 = 2) AS b2, max(CASE WHEN doc_id % 3 = 0 THEN '---' ELSE x END) FILTER (j % 5 = 4) AS b4 FROM l GROUP BY ALL),
  k AS (SELECT *, i3 = 1 AND (doc_id % 2 = 0 OR regexp_full_match(b2, '\\s*(-{3,}|_{3,}|\\((?i:click|tap)\\b[^)]*(?i:chart|version)[^)]*\\))?\\s*')) AS one, 'raw/crypto_archive/img/' || (5 * m + 1) || '.png' AS a, '(remote: http://h/' || (5 * m + 3) || '.png)' AS z FROM g WHERE i1 = 1),
  b AS (SELECT doc_id, m, 1 AS part, CASE WHEN one THEN a || ',' || z ELSE a END AS images, CASE WHEN i3 = 1 THEN a || ',' || z ELSE a END AS candidates, CASE WHEN one THEN b4 ELSE b2 END AS body FROM k
    UNION ALL SELECT doc_id, m, 2, z, z, b4 FROM k WHERE i3 = 1 AND NOT one),
  blocks AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY m, part) - 1 AS INT) AS block, regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') AS said FROM b)"""
CANON = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"

def j16_card_images(spark: SparkSession, d: str) -> DataFrame:
    """A card for each order with its customer's image, from a book, a post that shows it, or a post that a manifest maps it to."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = F.col("c_custkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    image = lambda x: text("raw/i/i", x, ".png")
    url, fraser = lambda x: text("http://h/", x), lambda x: text("raw/bruce_fraser/posts/f", x % 7, ".md")
    own = F.when(k % 4 == 0, F.format_string("raw/book/pages/page_%03d.md", k % 900)).when(k % 4 == 1, text("raw/crypto_archive/posts/p", c + F.when(k % 3 == 0, 1).otherwise(0), ".md")).when(k % 4 == 2, fraser(k)).otherwise("notes.md")
    shown = F.when(c % 10 == 0, text("(remote: ", url(c), ")")).when(k % 31 == 0, "/abs.png").when(k % 37 == 0, "bez slike").otherwise(image(c))
    fields = F.create_map(F.lit("source"), own, F.lit("image_path"), shown, F.lit("page"), F.when(k % 3 == 0, c % 900).otherwise(k % 900).cast("string"))
    cards = table(spark, d, "orders").select(k.cast("string").alias("path"), fields.alias("fields"))
    people = table(spark, d, "customer")
    files, book = people.where(n % 6 != 0).select(image(n).alias("path")), people.where(n % 5 != 0).select(image(n).alias("image_path"), (n % 900).cast("int").alias("page_number"))
    posts = people.select(text("raw/crypto_archive/posts/p", n, ".md").alias("path"), text("URL: x\n![a](../../i/i", n, ".png)\n").alias("text"))
    local, remote = people.select(image(n).alias("key"), fraser(n).alias("post")), people.where(n % 20 == 0).select(url(n).alias("key"), fraser(n).alias("post"))
    return evidence.card_image_findings(cards, files, book, posts, local, remote)


IMAGES = "raw/bruce_fraser/images"


def j17_image_evidence(spark: SparkSession, d: str) -> DataFrame:
    """An image file for each benchmark item (some are missing), an artifact with a reading of each (some of other bytes), and a card for each order."""
    i = F.col("item_id")
    items = table(spark, d, "benchmark").select(i, F.concat(F.lit(f"{IMAGES}/img_"), i.cast("string"), F.lit(".png")).alias("image_path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    at = scratch(spark, "images").removeprefix("file://")
    published.publish(items.where(i % 11 != 0).select(F.col("image_path").alias("path"), "content"), at, kind="files")
    root = f"file://{at}/{published.manifest(at)[0]['path'].split('/')[0]}"
    read = lambda v, agreed: F.struct(v.alias("value"), F.lit(True).alias("decision_eligible"), F.array(v, F.when(agreed, v).otherwise("other")).alias("runs"), F.array(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("evidence"))
    sha = F.when(i % 7 == 0, F.sha2(F.lit("old").cast("binary"), 256)).otherwise(F.sha2("content", 256))
    image = F.to_json(F.struct("image_path", sha.alias("sha256"), read(F.when(i % 2 == 0, "BTC").otherwise("INDU"), i % 5 != 0).alias("asset"), read(F.when(i % 3 == 0, "daily").otherwise("4 hr"), F.lit(True)).alias("timeframe")))
    generator = {"parser_version": ocr.PARSER, "minimum_confidence": ocr.LEAST_CONFIDENCE, "runs_per_image": ocr.RUNS, "engine": ocr.ENGINE, "recognition_language": ocr.LANGUAGE, "uses_language_correction": False, "toolchain": {}}
    head = json.dumps({"schema": ocr.SCHEMA, "generator": generator})[:-1]
    # an artifact for twenty items
    artifacts = items.groupBy(F.floor(i / 20)).agg(F.concat(F.lit(head + ', "images": ['), F.array_join(F.collect_list(image), ", "), F.lit("]}")).alias("payload"))
    n = items.count()
    k = F.col("o_orderkey")
    cards = table(spark, d, "orders").select(k.alias("k"), k.cast("string").alias("path"), F.when(k % 6 == 0, "raw/crypto_archive/posts/p.md").otherwise("raw/bruce_fraser/posts/p.md").alias("source"), F.concat(F.lit(f"{IMAGES}/img_"), (k % n).cast("string"), F.lit(".png")).alias("image_path"), F.when(k % 4 == 0, "btc").when(k % 4 == 1, "DJIA and ETH").when(k % 4 == 2, "unknown").otherwise("ETH").alias("asset"), F.when(k % 5 < 2, "Daily").when(k % 5 < 4, "4-hour point and figure").otherwise("odd").alias("timeframe"))
    return ocr.evidence_findings(cards, ocr.observations(artifacts), ocr.image_files(spark, root, IMAGES))


SQL = {
    "j16_card_images": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 4 AS t FROM orders), x AS (SELECT k, CASE WHEN c % 10 = 0 THEN CASE WHEN NOT (t = 2 AND k % 7 = c % 7 AND c % 20 = 0) THEN 'image_provenance' END WHEN k % 31 = 0 THEN 'image_absolute' WHEN k % 37 = 0 THEN 'image_none' WHEN c % 6 = 0 THEN 'image_missing'
      WHEN t = 0 AND NOT (c % 5 <> 0 AND (k % 3 = 0 OR c % 900 = k % 900)) THEN 'image_provenance' WHEN t = 1 AND k % 3 = 0 THEN 'image_provenance' WHEN t = 2 AND k % 7 <> c % 7 THEN 'image_provenance' END AS code FROM o) SELECT CAST(k AS VARCHAR) AS path, code FROM x WHERE code IS NOT NULL""",
    "j17_image_evidence": """WITH n AS (SELECT count(*) AS n FROM benchmark), c AS (SELECT o_orderkey AS k, o_orderkey % n AS i, o_orderkey % 4 AS a, o_orderkey % 5 AS t FROM orders, n WHERE o_orderkey % 6 <> 0), m AS (SELECT * FROM c JOIN benchmark ON item_id = i WHERE i % 11 <> 0),
      st AS (SELECT CAST(k AS VARCHAR) AS path, i, row_number() OVER (PARTITION BY i ORDER BY CAST(k AS VARCHAR)) AS r FROM m WHERE i % 7 = 0)
      SELECT path, 'W-EXTRACT-OCR-EVIDENCE-SKIPPED' AS code, NULL AS field FROM st WHERE r = 1
      UNION ALL SELECT CAST(k AS VARCHAR), 'F-EXTRACT-OCR-METADATA-CONTRADICTION', 'asset' FROM m WHERE i % 7 <> 0 AND i % 5 <> 0 AND CASE a WHEN 0 THEN i % 2 = 1 WHEN 1 THEN i % 2 = 0 WHEN 2 THEN false ELSE true END
      UNION ALL SELECT CAST(k AS VARCHAR), 'F-EXTRACT-OCR-METADATA-CONTRADICTION', 'timeframe' FROM m WHERE i % 7 <> 0 AND CASE WHEN t < 2 THEN i % 3 <> 0 WHEN t < 4 THEN i % 3 = 0 ELSE false END""",
    "w09_evidence_blocks": f"WITH {LINES} SELECT 'raw/crypto_archive/posts/d' || doc_id || '.md' AS path, block, 'H' || (5 * m) AS heading, images, md5(said) AS body FROM blocks",
    "w11_image_candidates": f"WITH {LINES} SELECT 'raw/crypto_archive/posts/d' || doc_id || '.md' AS path, block, candidates FROM blocks",
    "t17_quote_blocks": f"""WITH {LINES}, q AS (SELECT doc_id, CASE WHEN lines[5] <> '' THEN lines[5] END AS q1, CASE WHEN doc_id % 4 = 3 AND lines[3] <> '' THEN lines[3] END AS q2 FROM x WHERE len(lines) > 4)
      SELECT 'card/' || doc_id AS path, min(block) AS block FROM q JOIN blocks USING (doc_id) WHERE coalesce(q1, q2) IS NOT NULL AND (q1 IS NULL OR contains({CANON.format(x='said')}, {CANON.format(x='q1')})) AND (q2 IS NULL OR contains({CANON.format(x='said')}, {CANON.format(x='q2')})) GROUP BY doc_id HAVING count(*) = 1""",
    "t13_source_findings": """WITH c AS (SELECT doc_id, doc_id % 12 AS k, doc_id % 40 IN (SELECT item_id FROM benchmark WHERE item_id % 9 <> 4) AS page FROM documents)
      SELECT 'card/' || doc_id AS path, unnest(CASE WHEN k = 0 THEN ['source_absolute'] WHEN k = 1 THEN ['source_place'] WHEN k IN (2, 10) THEN ['source_missing'] WHEN k IN (3, 4, 5, 11) AND NOT page THEN ['source_missing'] WHEN k IN (4, 11) THEN ['book_page'] WHEN k = 5 THEN ['book_post_url'] WHEN k = 6 THEN ['post_page'] WHEN k = 7 THEN ['post_url'] ELSE [] END) AS code FROM c""",
    "t14_page_spans": "WITH c AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 900 AS n FROM documents) SELECT 'card/' || doc_id AS path, CASE WHEN k = 0 THEN CAST(n AS VARCHAR) WHEN k = 1 THEN n || ',' || (n + 1) END AS span, CASE WHEN k = 2 THEN 'page_range_reach' WHEN k = 4 THEN 'page_range_form' END AS code FROM c",
    "t18_quote_findings": """WITH c AS (SELECT d.doc_id, d.doc_id % 4 AS k, doc_id % 40 AS n, a.text AS own, b.text AS nxt, string_split(regexp_replace(d.text, '[#!>\\r]', '.', 'g'), chr(10)) AS lines FROM documents d LEFT JOIN benchmark a ON d.doc_id % 40 = a.item_id LEFT JOIN benchmark b ON d.doc_id % 40 + 1 = b.item_id),
      q AS (SELECT *, trim(substr(regexp_replace(coalesce(nxt, 'none'), '\\s+', ' ', 'g'), 11, 50)) AS quote FROM c),
      r AS (SELECT doc_id, CASE WHEN k = 1 THEN ['quote_absent'] WHEN k = 3 THEN ['quote_missing'] WHEN k = 0 THEN []
        WHEN own IS NULL OR n % 9 = 4 THEN [] WHEN doc_id % 16 = 6 THEN ['page_range_reach']
        WHEN doc_id % 8 = 2 AND (nxt IS NULL OR (n + 1) % 9 = 4) THEN CASE WHEN quote = '' THEN ['range_page_missing', 'quote_missing'] ELSE ['range_page_missing', 'quote_absent'] END
        WHEN quote = '' THEN ['quote_missing'] WHEN doc_id % 8 = 2 THEN [] WHEN contains(trim(regexp_replace(own, '\\s+', ' ', 'g')), quote) THEN [] ELSE ['quote_absent'] END AS codes FROM q)
      SELECT 'card/' || doc_id AS path, unnest(codes) AS code FROM r""",
}
QUERIES = {name: globals()[name] for name in SQL}
