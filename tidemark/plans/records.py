"""Queries over records at rest, made from orders, line items, events, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, rules
from . import evaluation, market
from .common import r6, table


def p03_open_positions(spark: SparkSession, d: str) -> DataFrame:
    return records.positions_of(evaluation.b10_positions(spark, d), "open").select("portfolio", "id", "symbol")


def p04_bar_range(spark: SparkSession, d: str) -> DataFrame:
    return records.bars_between(market._daily(spark, d), 820454400000, 825552000000).select("symbol", "open_time")


def p07_selected_specs(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("case_"), F.col("o_custkey") % 10).alias("case_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("effort"))
    return records.selected(specs, case_id=["case_1", "case_4"], model=[], effort=["F", "P"])


def _refs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    url = F.when(i % 3 == 0, F.concat(F.lit("//d.stockcharts.com/img/articles/"), i % 50)).when(i % 3 == 1, F.concat(F.lit(records.ARTICLE_IMAGES), i % 50)).otherwise(F.col("url"))
    return table(spark, d, "pages").select((i % 20).alias("post"), url.alias("url"), (i % 4 < 3).alias("in_body"), F.octet_length("html").alias("bytes"))


def p11_article_images(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).where(records.article_image(F.col("url"))).groupBy("url").agg(F.count("*").alias("n"))


def a25_image_counters(spark: SparkSession, d: str) -> DataFrame:
    return records.image_counters(_refs(spark, d))


def t28_scan_artifacts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    seed = F.when(i % 5 == 0, "the Gre ater part").when(i % 5 == 1, "tra ding by Selle rs").when(i % 5 == 2, "WYCKO  FF").otherwise("")
    return records.scan_artifacts(table(spark, d, "documents").select(i.alias("path"), F.concat("text", F.lit(" "), seed).alias("text")))


def t25_block_text(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document is a line of a block, each word a span with white space of two kinds after it."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.transform(F.split(x, " "), lambda w: F.concat(w, F.lit("  "))))
    return table(spark, d, "documents").select("doc_id", F.md5(records.block_text(lines)).alias("text"))


def t27_image_manifest(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    figures = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), n.alias("block_no")).agg(F.max(q).alias("q")).select("page", "block_no", *((F.col("q") / k).alias(c) for c, k in (("left", 3), ("top", 7), ("right", 2), ("bottom", 6))), (F.col("q") * 3).alias("width"), (F.col("q") * 2).alias("height"))
    got = records.image_manifest(figures, "raw/images")
    return got.select("image_path", "page_number", "figure_index", r6("position_in_page.top", "top"), r6("position_in_page.right", "right"))


def a27_summed_usage(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    one = F.when(k % 5 != 0, F.struct(c.alias("input_tokens"), F.when(k % 3 != 0, k).alias("output_tokens")))
    two = F.struct(k.alias("input_tokens"), F.lit(7).cast("bigint").alias("output_tokens"))
    got = records.summed_usage(one, two)
    return table(spark, d, "orders").select(k.alias("run"), got["input_tokens"].alias("input_tokens"), got["output_tokens"].alias("output_tokens"))


def h07_dimensions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    got = records.dimension(F.when(i % 6 != 0, i % 5 / 4.0), "deterministic")
    return table(spark, d, "events").select("event_id", got["score"].alias("score"), got["status"].alias("status"))


def h09_after_cutoff(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    bars = lambda x: F.array(F.lit(x), k.cast("double"))
    got = records.after_cutoff(F.when(k % 3 == 0, bars(1.0)), F.when(k % 2 == 0, bars(2.0)), k % 5 == 0)
    return table(spark, d, "orders").select(k.alias("case_id"), F.array_join(got["bars"].cast("array<bigint>").cast("array<string>"), ",").alias("bars"), got["fallback"].alias("fallback"))


def h15_journal_problems(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a journal for all events, analyses and reviews in turn, flawed by number."""
    i, at = F.col("event_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    time = F.when(i % 7 == 3, F.lit("soon")).otherwise(at)
    text = lambda k, v: F.concat(F.lit(f', "{k}": "'), v, F.lit('"'))
    head = F.concat(F.lit('{"analysis_id": "'), i.cast("string"), F.lit('"'))
    rest = F.concat(*(text(c, F.col("event_type")) for c in ("symbol", "timeframe", "model", "effort", "narrative", "structure")), F.when(i % 11 == 4, "").otherwise(', "phase": "C"'), F.lit(', "forecast": {}'), F.when(i % 13 == 4, "").otherwise(', "review": null'))
    analysis = F.concat(head, text("logged_at", time), rest, F.when(i % 17 == 0, ', "type": "odd"').otherwise(""), F.lit("}"))
    flag = F.when(i % 5 == 1, F.lit('"yes"')).otherwise("true")
    review = F.concat(head, F.lit(', "type": "review", "review": {"hit_trigger": '), flag, text("reviewed_at", time), F.when(i % 9 == 1, "").otherwise(', "note": "n"'), text("realized_direction", F.lit("up")), F.lit("}}"))
    line = F.when(i % 19 == 0, "[1, 2]").when(i % 23 == 0, '{"analysis_id": ').when(i % 2 == 0, analysis).otherwise(review)
    return table(spark, d, "events").select("event_id", records.journal_problem(line).alias("problem"))


def k02_analysis_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    texts = [F.when(k % 10 == n, " \t").otherwise(F.col("o_orderpriority")).alias(c) for n, c in enumerate(records.ANALYSIS_TEXTS)]
    of = [F.when(k % 12 == n + 8, "").otherwise("x").alias(c) for n, c in enumerate(records.FORECAST_TEXTS)]
    sure = F.when(k % 7 == 0, None).when(k % 7 == 1, F.lit(float("nan"))).when(k % 7 == 2, 1.5).otherwise(k % 3 / 2.0)
    made = table(spark, d, "orders").select(k.alias("key"), *texts, F.struct(*of, sure.cast("double").alias("confidence")).alias("forecast"))
    return made.select("key", records.analysis_problem().alias("problem"))


def h18_seeded_portfolios(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("a/"), "p_name")).when(k % 6 == 1, F.concat(F.lit("a\\"), "p_name")).when(k % 6 == 2, "..").when(k % 6 == 3, "").otherwise(F.concat("p_name", F.lit("."), k))
    return records.seeded(table(spark, d, "part").select(name.alias("name")), 10000.0)


def b16_allowed_answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    extra = F.when(k % 2 == 0, F.lit("decisive")).otherwise(F.lit("source_path"))
    answer = F.create_map(F.lit("event_type"), F.col("o_orderpriority"), extra, F.lit("x"), F.lit("cutoff"), F.lit("y"))
    got = records.allowed_answers(answer)
    return table(spark, d, "orders").select(k.alias("key"), F.array_join(F.array_sort(F.map_keys(got)), ",").alias("keys"), F.try_element_at(got, F.lit("event_type")).alias("event_type"))


def k07_manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    keys = [k.alias("case_id"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("mode"), (k % 2 == 0).alias("reveal")]
    old = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(*keys, F.lit("old").alias("path"))
    new = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(*keys, F.lit("new").alias("path"))
    return records.upserted(old, new)


def f22_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    values = {"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "cust": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))}
    return table(spark, d, "orders").select("o_orderkey", records.fingerprint(values).alias("print"))


def r08_evaluate_rule(spark: SparkSession, d: str) -> DataFrame:
    """Relative strength of one symbol among all."""
    bars = market._daily(spark, d)
    return records.evaluate_rule(bars, "PROMO", "1d", rules.RELATIVE_STRENGTH, bars.select("symbol"), market.REFERENCE).select("symbol", "match", r6("score", "score"))


CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+([,.;:!?%)\\]])', '\\1', 'g'), '\\(\\s+', '(', 'g')"
REFS = "refs AS (SELECT page_id % 20 AS post, CASE WHEN page_id % 3 = 0 THEN '//d.stockcharts.com/img/articles/' || (page_id % 50) WHEN page_id % 3 = 1 THEN 'https://d.stockcharts.com/img/articles/' || (page_id % 50) ELSE url END AS url, page_id % 4 < 3 AS in_body, octet_length(encode(html)) AS bytes FROM pages)"

SQL = {
    "p03_open_positions": "SELECT o_orderkey % 5 AS portfolio, o_orderkey AS id, o_orderpriority AS symbol FROM orders WHERE o_orderstatus <> 'F'",
    "p04_bar_range": f"WITH {market.WIDE} SELECT symbol, open_time FROM bars WHERE open_time BETWEEN 820454400000 AND 825552000000",
    "p07_selected_specs": "SELECT o_orderkey AS run, 'case_' || (o_custkey % 10) AS case_id, o_orderpriority AS model, o_orderstatus AS effort FROM orders WHERE o_custkey % 10 IN (1, 4) AND o_orderstatus IN ('F', 'P')",
    "p11_article_images": f"WITH {REFS} SELECT url, count(*) AS n FROM refs WHERE regexp_matches(url, '^(https:)?//d\\.stockcharts\\.com/img/articles/') GROUP BY url",
    "a25_image_counters": f"WITH {REFS} SELECT count(DISTINCT post) AS posts, count(*) AS refs, count(*) FILTER (in_body) AS inserted, count(DISTINCT url) AS urls, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM refs",
    "t28_scan_artifacts": "SELECT doc_id AS path, p AS pattern FROM (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN ' the Gre ater part' WHEN 1 THEN ' tra ding by Selle rs' WHEN 2 THEN ' WYCKO  FF' ELSE ' ' END) AS t FROM documents), (VALUES ('gre ater'), ('selle rs'), ('tra ding'), ('wycko ff')) v(p) WHERE contains(t, p)",
    "t25_block_text": f"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS j FROM documents), c AS (SELECT doc_id, j, {CLEAN.format(x='x')} AS x FROM l) SELECT doc_id, md5(coalesce(string_agg(x, chr(10) ORDER BY j) FILTER (x <> ''), '')) AS text FROM c GROUP BY doc_id",
    "t27_image_manifest": "WITH f AS (SELECT l_orderkey AS page_number, l_linenumber AS b, max(l_quantity) AS q FROM lineitem GROUP BY ALL), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_number ORDER BY b) AS INT) AS figure_index FROM f WHERE q >= 25) SELECT format('raw/images/page_{:03d}_fig_{}.png', page_number, figure_index) AS image_path, page_number, figure_index, round(q / 7, 2) AS top, round(q / 2, 2) AS \"right\" FROM n",
    "a27_summed_usage": "SELECT o_orderkey AS run, o_orderkey + CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey ELSE 0 END AS input_tokens, 7 + CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderkey ELSE 0 END AS output_tokens FROM orders",
    "h07_dimensions": "SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN (event_id % 5) / 4 END AS score, CASE WHEN event_id % 6 = 0 THEN 'na' ELSE 'scored' END AS status FROM events",
    "h09_after_cutoff": "SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN '1,' || o_orderkey WHEN o_orderkey % 2 = 0 THEN '2,' || o_orderkey ELSE '' END AS bars, o_orderkey % 3 <> 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 5 <> 0) AS fallback FROM orders",
    "h15_journal_problems": """WITH e AS (SELECT event_id, event_id AS i FROM events) SELECT event_id, CASE WHEN i % 19 = 0 OR i % 23 = 0 THEN 'not an object' WHEN i % 2 = 1 AND i % 9 = 1 THEN 'review lacks note' WHEN i % 2 = 1 AND i % 5 = 1 THEN 'hit_trigger' WHEN i % 2 = 1 AND i % 7 = 3 THEN 'reviewed_at' WHEN i % 2 = 1 THEN NULL
      WHEN i % 17 = 0 THEN 'unsupported type' WHEN i % 11 = 4 AND i % 13 = 4 THEN 'analysis lacks phase, review' WHEN i % 11 = 4 THEN 'analysis lacks phase' WHEN i % 13 = 4 THEN 'analysis lacks review' WHEN i % 7 = 3 THEN 'logged_at' END AS problem FROM e""",
    "k02_analysis_problems": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 < 7 THEN ['symbol', 'timeframe', 'model', 'effort', 'narrative', 'structure', 'phase'][o_orderkey % 10 + 1] WHEN o_orderkey % 12 BETWEEN 8 AND 10 THEN ['forecast.direction', 'forecast.trigger', 'forecast.invalidation'][o_orderkey % 12 - 7] WHEN o_orderkey % 7 < 3 THEN 'forecast.confidence' END AS problem FROM orders",
    "h18_seeded_portfolios": "SELECT p_name || '.' || p_partkey AS name, CAST(10000 AS DOUBLE) AS starting_cash, CAST(10000 AS DOUBLE) AS cash, 1 AS next_id FROM part WHERE p_partkey % 6 > 3",
    "b16_allowed_answers": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'decisive,event_type' ELSE 'event_type' END AS keys, o_orderpriority AS event_type FROM orders",
    "k07_manifest_upsert": "SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS mode, o_orderkey % 2 = 0 AS reveal, CASE WHEN o_orderkey % 5 <> 0 THEN 'new' ELSE 'old' END AS path FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 0",
    "f22_fingerprints": """SELECT o_orderkey, sha256('{"cust":' || CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'null' END || ',"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS print FROM orders""",
    "r08_evaluate_rule": f"SELECT * FROM ({market.SQL['r05_relative_strength']}) WHERE symbol = 'PROMO'",
}

QUERIES = {name: globals()[name] for name in SQL}
