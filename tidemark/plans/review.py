"""Queries over reviews of pages and over what runs begin from; pages are made from documents, answers and batches from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review
from .common import table


def _id() -> Column:
    return F.col("doc_id")


def _path() -> Column:
    i = _id().cast("string")
    content = F.concat(F.lit("knowledge/wiki/concepts/c"), i, F.lit(".md"))
    return (
        F.when(_id() % 11 == 0, "knowledge/wiki/index.md").when(_id() % 11 == 1, "knowledge/wiki/log.md")
        .when(_id() % 11 == 2, F.concat(F.lit("knowledge/wiki/health/citation-audit-"), i, F.lit(".md")))
        .when(_id() % 11 == 3, F.concat(F.lit("knowledge/wiki/sources/s"), i, F.lit(".md"))).otherwise(content)
    )


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Each seven documents are one change; every thirteenth is deleted, half of the others are new."""
    head = F.concat(F.when(_id() % 3 == 0, "## Summary\n").otherwise(""), F.when(_id() % 5 < 2, "## Key Lessons\n").otherwise(""), F.when(_id() % 17 == 4, "WIKI_GAP\n").otherwise(""))
    status = F.when(_id() % 13 == 0, "D").when(_id() % 2 == 0, "A").otherwise("M")
    return table(spark, d, "documents").select(F.floor(_id() / 7).alias("pr"), "doc_id", status.alias("status"), _path().alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def s10_answers(spark: SparkSession, d: str) -> DataFrame:
    """A key for each customer, in one of the three shapes; its cases are the customer's orders."""
    case = F.struct(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("event_type"))
    keyed = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.collect_list(case).alias("cases"))
    by_case = F.map_from_entries(F.transform("cases", lambda c: F.struct(c.case_id.cast("string"), F.struct(c.event_type.alias("event_type")))))
    text = F.when(F.col("file") % 3 == 0, F.to_json("cases")).when(F.col("file") % 3 == 1, F.to_json(F.struct("cases"))).otherwise(F.to_json(by_case))
    return review.answers(keyed.select(F.col("file").cast("string").alias("file"), text.alias("text"))).select("file", "case_id", F.col("answer")["event_type"].alias("event_type"))


def s14_changed_pages(spark: SparkSession, d: str) -> DataFrame:
    changed = _changed(spark, d)
    return review.changed_pages(changed.select("pr", F.concat_ws("\t", "status", "path").alias("line")), changed.where("doc_id % 10 < 9")).select("pr", "path", "present")


def t10_link_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Links of one to six steps up to forty files, of which a third is missing; images are no links."""
    page = F.when(_id() % 2 == 0, F.concat(F.lit("knowledge/wiki/d"), _id(), F.lit(".md"))).otherwise(F.concat(F.lit("knowledge/wiki/concepts/d"), _id(), F.lit(".md")))
    link = F.concat(F.expr("repeat('../', cast(doc_id % 6 + 1 as int))"), F.lit("raw/book/p"), _id() % 40, F.lit(".md"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n[see]("), link, F.lit(") ![chart](../raw/i.png)"))
    docs = table(spark, d, "documents")
    raw = docs.where("doc_id % 40 % 3 <> 1").select(F.concat(F.lit("raw/book/p"), _id() % 40, F.lit(".md")).alias("path"))
    return review.link_repairs(docs.select(page.alias("path"), text.alias("text")), raw)


def t11_review_findings(spark: SparkSession, d: str) -> DataFrame:
    return review.review_findings(_changed(spark, d)).select("pr", "path", "code")


def h24_encoding_findings(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a stray byte, a cut character or a whole one at their end."""
    tail = F.when(_id() % 6 == 0, F.unhex(F.lit("FF"))).when(_id() % 6 == 1, F.unhex(F.lit("E282"))).otherwise(F.unhex(F.lit("E282AC")))
    content = F.concat(F.encode(F.coalesce("text", F.lit("")), "utf-8"), tail)
    return review.encoding_findings(table(spark, d, "documents").select(_id().cast("string").alias("path"), content.alias("content")))


def h32_incomplete(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), "page_id").alias("slug"))
    return review.incomplete(entries.select("slug"), entries.where("page_id % 3 > 0"), entries.where("page_id % 5 > 0"), entries.where("page_id % 7 > 0"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.when(k % 3 > 0, F.col("o_custkey").cast("long")).alias("pages"), F.when(k % 5 > 0, F.col("o_orderpriority")).alias("remaining"), F.lit("").alias("note"))


def h36_blocked_batches(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "orders").where("o_orderkey % 4 < 2").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "complete").otherwise("failed").alias("after"))
    return review.block_completed(_batches(spark, d), changed, "not proven")


def h38_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A verdict for each order; some lack a field, hold no identity object or are cut."""
    k = F.col("o_orderkey")
    fields = {f: F.lit("x") for f in review.VERDICT_FIELDS} | {"passed": k % 2 == 0, "canary": F.col("o_orderpriority"), "recorded_at": F.when(k % 5 > 0, F.col("o_orderdate").cast("string"))}
    identity = F.when(k % 7 > 0, F.to_json(F.struct(F.col("o_orderstatus").alias("user")))).otherwise('"none"')
    rest = F.to_json(F.struct(*(v.alias(f) for f, v in fields.items() if f != "execution_identity")))
    text = F.concat(F.regexp_replace(rest, r"\}$", ""), F.lit(', "execution_identity": '), identity, F.when(k % 11 > 0, "}").otherwise(""))
    got = review.recorded_verdicts(table(spark, d, "orders").select(k.alias("file"), text.alias("text")))
    return got.where("verdict IS NOT NULL").select("file", "verdict.passed", "verdict.canary", F.col("verdict.execution_identity")["user"].alias("user"), "verdict.detail")


def b23_missing_snapshots(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"))
    angle = F.when(F.col("case_id") % 3 == 0, "leakage").when(F.col("case_id") % 3 == 1, "lookahead").otherwise("baseline")
    return review.missing_snapshots(cases, cases.where("case_id % 5 > 0").withColumn("angle", angle))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """A card for each order; events by its customer, structures by its status, the source by its key."""
    c = F.col("o_custkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("wiki/extracts/x"), "o_orderkey", F.lit(".md")).alias("path"), F.when(c % 5 == 0, "none").otherwise(F.concat(F.lit("e"), c % 5)).alias("event"),
        F.when(c % 3 == 0, F.concat(F.lit("e"), c % 4, F.lit(", e9 ,"))).alias("related_events"), F.col("o_orderstatus").alias("structure"), F.lit(None).cast("string").alias("related_structures"), F.concat(F.lit("raw/s"), F.col("o_orderkey") % 20, F.lit(".md")).alias("source"),
    )


def j15_taxonomy_findings(spark: SparkSession, d: str) -> DataFrame:
    """Index pages e0 to e7 and two of structures; each links a fifth of the cards, by either form of link, and names ten of the sources."""
    k = F.col("o_orderkey")
    link = F.when(k % 2 == 0, F.concat(F.lit("[[extracts/x"), k, F.lit("|card]]"))).otherwise(F.concat(F.lit("[card](../extracts/x"), k, F.lit(".md#top)")))
    indexes = spark.range(8).select(F.col("id").alias("n"), F.concat(F.lit("wiki/by-event/e"), "id", F.lit(".md")).alias("path")).unionByName(spark.createDataFrame([(1, "wiki/by-structure/F.md"), (2, "wiki/by-structure/O.md")], "n long, path string"))
    body = table(spark, d, "orders").select((k % 8).alias("n"), link.alias("link")).groupBy("n").agg(F.array_join(F.collect_list("link"), "\n").alias("body"))
    head = F.concat(F.lit("---\ntitle: i\nsources:\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.when(i % 2 == 0, "  - path: raw/s").otherwise("  - raw/s"), ((i * 2 + F.col("n")) % 20).cast("string"), F.lit(".md"))), "\n"), F.lit("\ntags:\n  - raw/s1.md\n---\n"))
    pages = indexes.join(body, "n", "left").select("path", F.concat(head, F.coalesce("body", F.lit(""))).alias("text"))
    return review.taxonomy_findings(_cards(spark, d), pages)


def j16_image_posts(spark: SparkSession, d: str) -> DataFrame:
    """A row of the manifest for each page; files of a seventh are missing."""
    i = F.col("page_id")
    rows = table(spark, d, "pages").select(i, F.concat(F.lit("raw/i"), i % 50).alias("path"), "url", F.when(i % 4 > 0, "available").otherwise("failed").alias("status"), F.array(F.concat(F.lit("p"), i % 9), F.concat(F.lit("p"), i % 5)).alias("posts"))
    local, remote = review.image_posts(rows, rows.where("page_id % 50 % 7 > 0"))
    return local.withColumn("kind", F.lit("local")).unionByName(remote.withColumn("kind", F.lit("remote")))


def h33_image_downloads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    return review.image_downloads(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slug"), F.col("l_linenumber").cast("long").alias("seq"), F.when(k % 9 > 0, F.concat(F.lit("http://h/"), k % 4)).otherwise("").alias("url")))


_PAGES = """WITH c AS (SELECT doc_id, doc_id // 7 AS pr, CASE WHEN doc_id % 13 = 0 THEN 'D' WHEN doc_id % 2 = 0 THEN 'A' ELSE 'M' END AS status,
  CASE doc_id % 11 WHEN 0 THEN 'knowledge/wiki/index.md' WHEN 1 THEN 'knowledge/wiki/log.md' WHEN 2 THEN 'knowledge/wiki/health/citation-audit-' || doc_id || '.md' WHEN 3 THEN 'knowledge/wiki/sources/s' || doc_id || '.md' ELSE 'knowledge/wiki/concepts/c' || doc_id || '.md' END AS path, coalesce(text, '') AS text FROM documents)"""
_LINKS = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'knowledge/wiki/d' ELSE 'knowledge/wiki/concepts/d' END || doc_id || '.md' AS path, 2 + doc_id % 2 AS depth,
  coalesce(text, '') || chr(10) || '[see](' || repeat('../', CAST(doc_id % 6 + 1 AS INT)) || 'raw/book/p' || doc_id % 40 || '.md) ![chart](../raw/i.png)' AS text FROM documents),
  l AS (SELECT path, depth, unnest(regexp_extract_all(text, '(?:^|[^!])\\[[^\\]\\n]+\\]\\(((?:\\.\\./)+raw/[^)\\s]+)\\)', 1)) AS target FROM d),
  r AS (SELECT DISTINCT 'raw/book/p' || doc_id % 40 || '.md' AS file FROM documents WHERE doc_id % 40 % 3 <> 1),
  s AS (SELECT *, regexp_replace(target, '^(\\.\\./)+', '') AS tail FROM l)"""

SQL = {
    "s10_answers": "SELECT CAST(o_custkey AS VARCHAR) AS file, CAST(o_orderkey AS VARCHAR) AS case_id, o_orderpriority AS event_type FROM orders",
    "s14_changed_pages": f"""{_PAGES} SELECT pr, path, path IN (SELECT path FROM c WHERE doc_id % 10 < 9) AS present FROM c WHERE status <> 'D' AND path NOT LIKE '%/health/%'""",
    "t10_link_repairs": f"""{_LINKS} SELECT path, target, CASE WHEN tail IN (SELECT file FROM r) THEN repeat('../', CAST(depth AS INT)) || tail END AS suggestion FROM s
      WHERE NOT (len(target) - len(tail) = 3 * depth AND tail IN (SELECT file FROM r))""",
    "t11_review_findings": f"""{_PAGES}, p AS (SELECT *, doc_id % 11 > 3 AS styled FROM c WHERE status <> 'D'),
      n AS (SELECT pr, bool_or(doc_id % 11 = 0) AS idx, bool_or(doc_id % 11 = 1) AS log FROM c GROUP BY pr HAVING bool_or(status = 'A' AND doc_id % 11 > 2))
      SELECT pr, path, 'summary_missing' AS code FROM p WHERE styled AND doc_id % 3 <> 0 AND NOT contains(text, '## Summary')
      UNION ALL SELECT pr, path, 'key_points_missing' FROM p WHERE styled AND doc_id % 5 >= 2 AND NOT contains(text, '## Key ')
      UNION ALL SELECT pr, path, 'wiki_gap' FROM p WHERE doc_id % 11 NOT IN (1, 2) AND (doc_id % 17 = 4 OR contains(text, 'WIKI_GAP'))
      UNION ALL SELECT pr, 'knowledge/wiki/index.md', 'unchanged' FROM n WHERE NOT idx UNION ALL SELECT pr, 'knowledge/wiki/log.md', 'unchanged' FROM n WHERE NOT log""",
    "h24_encoding_findings": "SELECT CAST(doc_id AS VARCHAR) AS path, 'F-EXTRACT-ENCODING' AS code FROM documents WHERE doc_id % 6 < 2",
    "h32_incomplete": "SELECT 'p' || page_id AS slug FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0",
    "h36_blocked_batches": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'blocked' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey WHEN o_orderkey % 4 = 0 THEN 0 END AS pages,
      CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority WHEN o_orderkey % 4 = 0 THEN 'scope nije potvrđen' END AS remaining, CASE WHEN o_orderkey % 4 = 0 THEN 'not proven' ELSE '' END AS note FROM orders""",
    "h38_verdicts": """SELECT o_orderkey AS file, o_orderkey % 2 = 0 AS passed, o_orderpriority AS canary, o_orderstatus AS "user", '' AS detail FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0""",
    "b23_missing_snapshots": """SELECT o_orderkey AS case_id, angle FROM orders, (SELECT unnest(['baseline', 'leakage', 'lookahead']) AS angle)
      WHERE NOT (o_orderkey % 5 > 0 AND angle = CASE o_orderkey % 3 WHEN 0 THEN 'leakage' WHEN 1 THEN 'lookahead' ELSE 'baseline' END)""",
    "j15_taxonomy_findings": """WITH o AS (SELECT *, 'wiki/extracts/x' || o_orderkey || '.md' AS path, o_custkey AS c FROM orders),
      e AS (SELECT DISTINCT path, o_orderkey, unnest(list_concat(CASE WHEN c % 5 > 0 THEN ['by-event/e' || c % 5] ELSE [] END, CASE WHEN c % 3 = 0 THEN ['by-event/e' || c % 4, 'by-event/e9'] ELSE [] END, ['by-structure/' || o_orderstatus])) AS i FROM o),
      x AS (SELECT CAST(n AS BIGINT) AS n, 'by-event/e' || n AS i FROM range(8) t(n) UNION ALL VALUES (1, 'by-structure/F'), (2, 'by-structure/O')),
      f AS (SELECT e.*, x.n FROM e LEFT JOIN x USING (i))
      SELECT path, 'link_missing' AS code, string_agg('wiki/' || i || '.md', ', ' ORDER BY i) AS names FROM f WHERE n IS NULL OR o_orderkey % 8 <> n GROUP BY path
      UNION ALL SELECT path, 'source_missing', string_agg('wiki/' || i || '.md', ', ' ORDER BY i) FROM f WHERE n IS NULL OR (o_orderkey % 20 + n) % 2 = 1 GROUP BY path
      UNION ALL SELECT 'wiki/' || x.i || '.md', 'unrelated', 'x' || o.o_orderkey FROM x JOIN o ON o.o_orderkey % 8 = x.n ANTI JOIN e ON e.i = x.i AND e.o_orderkey = o.o_orderkey""",
    "j16_image_posts": """WITH r AS (SELECT 'raw/i' || page_id % 50 AS path, url, page_id % 4 = 0 OR page_id % 50 % 7 = 0 AS away, unnest(['p' || page_id % 9, 'p' || page_id % 5]) AS post FROM pages)
      SELECT DISTINCT path AS key, post, 'local' AS kind FROM r UNION ALL SELECT DISTINCT coalesce(url, ''), post, 'remote' FROM r WHERE away""",
    "h33_image_downloads": """SELECT l_orderkey AS slug, CAST(l_linenumber AS BIGINT) AS seq, 'http://h/' || l_partkey % 4 AS url, CAST(min(l_linenumber) OVER (PARTITION BY l_orderkey, l_partkey % 4) AS BIGINT) AS "first" FROM lineitem WHERE l_partkey % 9 > 0""",
}
QUERIES = {name: globals()[name] for name in SQL}
