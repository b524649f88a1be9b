"""Queries over forecasts, runs, journals and portfolios, on inputs made from orders, customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import ledgers
from .common import r6, table
from .market import HOURLY, WIDE, _daily, _hourly, _signals, _symbols


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark rows: a run for each order; duplicates of a case and side are resolved by ``seq``."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_orderkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        k.alias("seq"), (F.col("o_custkey") % 50).cast("string").alias("case_id"), F.col("c_mktsegment").alias("model"), F.col("o_orderpriority").alias("effort"),
        F.when(k % 3 == 2, "future_visible").otherwise("blind").alias("time_mode"), F.when(k % 3 == 1, "revealed").otherwise("anon").alias("anon_mode"), F.concat(F.lit("ev"), (k % 4).cast("string")).alias("event_type"),
        ((k % 1000) / 1000.0).alias("aggregate"), F.when(k % 5 != 0, (k % 700) / 700.0).alias("expert_alignment"), F.when(k % 7 != 0, (k % 300) / 300.0).alias("realized_outcome"), F.when(k % 11 != 0, k % 2000 + 1).alias("tokens_in"), (k % 900 + 1).alias("tokens_out"),
    )


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("AUTOMOBILE", 3.0, 15.0), ("BUILDING", 5.0, 25.0), ("MACHINERY", 10.0, 50.0), ("HOUSEHOLD", 1.0, 4.0)], "model string, price_in double, price_out double")


def _costed(spark: SparkSession, d: str) -> DataFrame:
    return ev.with_cost(_rows(spark, d), _prices(spark, d), digits=None)


def _forecasts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A forecast for each usable signal with a later bar, and the ten hourly bars after it."""
    from ..operators.backtest import next_bars, usable_signals
    from ..sources.bars import with_index

    i, v = F.col("signal_id"), F.col("invalidation")
    s = next_bars(usable_signals(_signals(spark, d)).drop("skip"), with_index(_hourly(spark, d)).select("symbol", "timeframe", "bar_idx", "open_time")).where("bar is not null")
    up = F.col("side") == "long"
    f = s.select(
        i.alias("id"), "symbol", F.col("bar.bar_idx").alias("at"), F.when(i % 35 == 0, "stand aside").when(up, "Bullish").otherwise("short").alias("direction"), F.when(up, F.col("target_zone")[0]).otherwise(F.col("target_zone")[0]).alias("trigger"), v.alias("invalidation"),
        ((i % 100) / 100.0).alias("confidence"), F.when(i % 45 == 0, "retrospective").otherwise("forward").alias("analysis_mode"), F.when(i % 25 == 0, F.lit(None)).otherwise(i % 20 != 0).cast("boolean").alias("decisive"), F.when(i % 15 == 0, F.lit(None)).when(i % 10 == 0, "higher").otherwise("flat").alias("realized_direction"),
    )
    b = with_index(_hourly(spark, d)).select("symbol", "bar_idx", "high", "low")
    ten = f.select("id", "symbol", "at", F.explode(F.sequence(F.col("at"), F.col("at") + 9)).alias("bar_idx"))
    walk = ten.join(b, ["symbol", "bar_idx"]).select("id", (F.col("bar_idx") - F.col("at") + 1).alias("i"), "high", "low")
    return f.drop("symbol", "at"), walk


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(_daily(spark, d)).select(F.col("symbol").alias("case_id"), "symbol", F.lit(946_684_800_000).alias("cutoff_ms"), F.lit(60).alias("n_bars"))


def b05_score_forecasts(spark: SparkSession, d: str) -> DataFrame:
    return ev.deterministic(*_forecasts(spark, d))


def b11_anonymised_snapshots(spark: SparkSession, d: str) -> DataFrame:
    visible, _ = ev.snapshot(_cases(spark, d), _daily(spark, d), digits=None)
    return visible.select("case_id", "open_time", *(r6(c, c) for c in ("open", "close")))


def b13_future_visible(spark: SparkSession, d: str) -> DataFrame:
    _, post = ev.snapshot(_cases(spark, d), _daily(spark, d), mode="future_visible")
    return post.groupBy("case_id").agg(F.count("*").alias("n"), F.min("open_time").alias("first"), F.max("open_time").alias("last"))


def b12_revealed(spark: SparkSession, d: str) -> DataFrame:
    visible, _ = ev.snapshot(_cases(spark, d), _daily(spark, d), reveal=True)
    # prices are rounded half up on their decimals here and on their doubles in SQL, so only their sums are compared
    return visible.groupBy("case_id").agg(F.count("*").alias("n"), F.min("open_time").alias("first"), F.round(F.sum("close"), 1).alias("close"))


def a15_combined_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda n: (k % n) / float(n)
    dims = table(spark, d, "orders").select(
        k.alias("id"), *(F.when(k % 7 != 0, part(n)).alias(x) for x, n in (("direction", 2), ("trigger", 3), ("invalidation", 5))), *(part(n).alias(x) for x, n in (("structure", 11), ("phase", 13), ("event", 17), ("narrative_quality", 19))), F.when(k % 29 != 0, part(23)).alias("calibration"),
    )
    return ev.combined(dims, digits=9).select("id", "aggregate", "expert_alignment", "realized_outcome", "verdict_ok")


def j11_run_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return ev.run_matrix(rows.select("case_id").distinct(), rows.select("model", "effort").distinct(), ["BUILDING"], ["1-URGENT"]).select("run_id", "case_id", "control", "snapshot_name")


def s11_parse_run_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq")
    ids = _rows(spark, d).select("seq", F.when(k % 9 == 0, F.concat_ws("__", "case_id", "model")).otherwise(F.concat_ws("__", "case_id", "time_mode", "anon_mode", "model", "effort")).alias("run_id"))
    return ev.parse_run_ids(ids)


def j09_ingest_skips(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq")
    r = _rows(spark, d).select(k.cast("string").alias("run_id"), "case_id", (k % 6 != 0).alias("filled"), k.alias("seq"))
    manifest = r.where("seq % 5 <> 0").select("run_id")
    answers = r.select("case_id").distinct().where("cast(case_id as int) % 10 <> 3")
    return ev.ingest(r, manifest, answers).groupBy(F.coalesce("skip", F.lit("scored")).alias("reason")).agg(F.count("*").alias("n"))


def f19_costs(spark: SparkSession, d: str) -> DataFrame:
    return _costed(spark, d).select("seq", "total_tokens", r6("cost_usd", "cost_usd"), F.round("roi", 9).alias("roi"), "roi_basis")


def a17_group_report(spark: SparkSession, d: str) -> DataFrame:
    g = ev.group_report(_costed(spark, d), digits=None)
    return g.select("model", "effort", "n", *(F.round(f"mean_{c}", 9).alias(f"mean_{c}") for c in ("aggregate", "expert_alignment", "realized_outcome", "total_tokens")), "roi_basis")


def a17_event_means(spark: SparkSession, d: str) -> DataFrame:
    return ev.event_means(_rows(spark, d), digits=None).withColumn("mean_aggregate", F.round("mean_aggregate", 9))


def o03_ranks(spark: SparkSession, d: str) -> DataFrame:
    return ev.ranked(ev.group_report(_costed(spark, d), digits=9)).select("model", "effort", "rank_aggregate", "rank_roi")


def a20_delta_leakage(spark: SparkSession, d: str) -> DataFrame:
    return ev.paired_delta(_rows(spark, d), "leakage", digits=9)


def a20_delta_lookahead(spark: SparkSession, d: str) -> DataFrame:
    return ev.paired_delta(_rows(spark, d), "lookahead", digits=9)


def b18_reconcile_runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    state = o.select(k.alias("run_id"), F.when(k % 4 == 0, "running").when(k % 4 == 1, "succeeded").otherwise("pending").alias("status"), F.when(k % 3 != 0, "analyst").alias("stage"), F.lit("analyst").alias("next_stage"), (k % 4).cast("int").alias("attempt"))
    checks = o.where(k % 2 == 0).select(k.alias("run_id"), (k % 6 != 0).alias("analyst_ok"), (k % 10 == 0).alias("complete"))
    return ev.reconcile(state, checks)


def b18_claimable_runs(spark: SparkSession, d: str) -> DataFrame:
    return ev.claimable(b18_reconcile_runs(spark, d), 3)


def b15_provenance_problems(spark: SparkSession, d: str) -> DataFrame:
    """A post for each document, with one image of its own; an answer to each, its excerpt moving over the lines and past them."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    line = F.regexp_replace(F.split(F.coalesce("text", F.lit("")), "\n")[0], r"[!\r]", ".")
    text = F.concat(F.lit("# Head\n"), line, F.lit("\n![chart](../images/i"), (i % 50).cast("string"), F.lit(".png)\nSee ![x](http://h/i.png)\nend\n"))
    posts = docs.where(i % 23 != 0).select(F.concat(F.lit("raw/crypto_archive/posts/d"), i.cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    images = spark.range(46).select(F.concat(F.lit("raw/crypto_archive/images/i"), "id", F.lit(".png")).alias("path"))
    image = F.when(i % 17 == 0, F.concat(F.lit("raw/crypto_archive/images/i"), i % 50 + 1, F.lit(".png"))).when(i % 19 == 0, "raw/other/i1.png").otherwise(F.concat(F.lit("raw/crypto_archive/posts/../images/i"), i % 50, F.lit(".png")))
    place = F.struct((1 + i % 5).cast("int").alias("start_line"), (i % 5 + i % 4).cast("int").alias("end_line"))
    stated = {f: F.lit("not_stated") for f in [*ev.PROVENANCE, *ev.EXPERT_LABELS]}
    stated |= {"source_path": F.concat(F.when(i % 13 == 0, "/").otherwise(""), F.lit("raw/crypto_archive/./posts/d"), i.cast("string"), F.lit(".md")), "source_image_path": image, "source_excerpt_location": place, "source_url": F.when(i % 7 != 0, "http://h"), "expert_phase": F.when(i % 11 == 0, " ").otherwise("C")}
    answers = docs.select(F.concat(F.lit("c"), i.cast("string")).alias("case_id"), *(c.alias(f) for f, c in stated.items()))
    return ev.provenance_problems(answers, posts, images)


def b15_case_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    cases = o.select(F.when(k % 37 == 0, F.lit("c0")).otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("case_id"), F.when(k % 13 == 0, " ").otherwise("BTC").alias("symbol"), F.lit("1d").alias("timeframe"), (k % 17).cast("int").alias("n_bars"))
    answers = o.where(k % 11 != 0).select(F.concat(F.lit("c"), k.cast("string")).alias("case_id"), F.when(k % 7 == 0, "guess").when(k % 3 == 0, "retrospective").otherwise("forward_looking").alias("analysis_mode"), F.when(k % 6 == 0, "not_applicable").otherwise("up").alias("realized_direction"), (k % 2 == 0).alias("decisive"), F.lit("spring").alias("event_type"), F.when(k % 19 == 0, "").otherwise("x").alias("ground_truth"))
    return ev.case_problems(cases, answers)


def f18_case_index(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.values import case_index

    return table(spark, d, "customer").select("c_custkey", case_index(F.col("c_name")).alias("place"))


def _analyses(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 2000).alias("analysis_id"), F.col("o_orderkey").alias("seq"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("logged_at"), F.col("o_orderpriority").alias("model"))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("analysis_id"), F.col("event_id").alias("seq"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("reviewed_at"), F.col("event_type").alias("realized_direction"), (F.col("event_id") % 2 == 0).alias("hit_trigger"))


def p02_list_analyses(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.listed(_analyses(spark, d), "1996-01-01T00:00:00Z", "1996-06-30T00:00:00Z", model="1-URGENT").select("analysis_id", "seq", "logged_at")


def p06_last_analysis(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.last_written(_analyses(spark, d), "analysis_id").select("analysis_id", "seq", "model")


def p06_first_signal(spark: SparkSession, d: str) -> DataFrame:
    a = _analyses(spark, d).withColumn("month", F.substring("logged_at", 1, 7))
    return ledgers.first_in_latest_month(a, "analysis_id").select("analysis_id", "seq", "month")


def j07_latest_reviews(spark: SparkSession, d: str) -> DataFrame:
    a = ledgers.last_written(_analyses(spark, d), "analysis_id").select("analysis_id", "model")
    return ledgers.with_reviews(a, _reviews(spark, d)).select("analysis_id", "model", F.col("review.realized_direction").alias("realized_direction"), F.col("review.hit_trigger").alias("hit_trigger"))


def k03_accepted_reviews(spark: SparkSession, d: str) -> DataFrame:
    return ledgers.accepted_reviews(_reviews(spark, d), _analyses(spark, d).where("analysis_id % 3 = 0")).groupBy("analysis_id").agg(F.count("*").alias("n"))


def k01_signal_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("signal_id")
    s = _signals(spark, d, flaws=True).withColumn("entry_zone", F.when(k % 6 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))).withColumn("symbol", F.when(k % 9 == 0, "a b").otherwise(F.col("symbol")))
    return ledgers.signal_problem(s).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


def b10_positions(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    base = [(k % 5).alias("portfolio"), k.alias("id")]
    opened = o.select(*base, k.alias("seq"), F.lit("open").alias("kind"), F.col("o_orderpriority").alias("symbol"), F.when(k % 2 == 0, "long").otherwise("short").alias("side"), (1.0 + k % 5).alias("size"), F.col("o_totalprice").alias("price"))
    closed = o.where("o_orderstatus = 'F'").select(*base, (k + 1).alias("seq"), F.lit("close").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("size"), (F.col("o_totalprice") * (0.9 + (k % 5) * 0.05)).alias("price"))
    return ledgers.fold_positions(opened.unionByName(closed))


def a13_portfolio_state(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.max("o_totalprice").alias("mark"))
    s = ledgers.portfolio_state(b10_positions(spark, d), marks, 100_000.0)
    return s.select("portfolio", "closed_count", "open_count", *(F.round(c, 2).alias(c) for c in ("realized", "unrealized", "cash", "equity")))


ROWS = """rows AS (SELECT o_orderkey AS seq, CAST(o_custkey % 50 AS VARCHAR) AS case_id, c_mktsegment AS model, o_orderpriority AS effort, CASE WHEN o_orderkey % 3 = 2 THEN 'future_visible' ELSE 'blind' END AS time_mode,
  CASE WHEN o_orderkey % 3 = 1 THEN 'revealed' ELSE 'anon' END AS anon_mode, 'ev' || (o_orderkey % 4) AS event_type, (o_orderkey % 1000) / 1000.0::DOUBLE AS aggregate, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 700) / 700.0::DOUBLE END AS expert_alignment,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 300) / 300.0::DOUBLE END AS realized_outcome, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 2000 + 1 END AS tokens_in, o_orderkey % 900 + 1 AS tokens_out FROM orders JOIN customer ON o_custkey = c_custkey)"""
COSTED = f"""{ROWS}, prices(model, pin, pout) AS (VALUES ('AUTOMOBILE', 3.0::DOUBLE, 15.0::DOUBLE), ('BUILDING', 5.0, 25.0), ('MACHINERY', 10.0, 50.0), ('HOUSEHOLD', 1.0, 4.0)),
cost AS (SELECT *, tokens_in + tokens_out AS total_tokens, (tokens_in * pin + tokens_out * pout) / 1000000 AS cost_usd, CASE WHEN pin IS NULL THEN 'tokens' ELSE 'usd' END AS roi_basis FROM rows LEFT JOIN prices USING (model)),
roid AS (SELECT *, round(CASE WHEN roi_basis = 'usd' THEN CASE WHEN cost_usd > 0 THEN aggregate / cost_usd END ELSE aggregate / (total_tokens / 1000.0::DOUBLE) END, 12) AS roi FROM cost)"""
GROUPS = f"""{COSTED}, g AS (SELECT model, effort, count(*) AS n, avg(aggregate) AS a, avg(expert_alignment) AS e, avg(realized_outcome) AS r, avg(total_tokens) AS t, avg(roi) AS roi, any_value(roi_basis) AS roi_basis FROM roid WHERE time_mode = 'blind' AND anon_mode = 'anon' GROUP BY 1, 2)"""
DELTA = ROWS + """, side AS (SELECT model, effort, case_id, arg_max(aggregate, seq) FILTER (time_mode = 'blind' AND anon_mode = 'anon') AS x, arg_max(aggregate, seq) FILTER ({to}) AS y FROM rows WHERE (time_mode = 'blind' AND anon_mode = 'anon') OR ({to}) GROUP BY 1, 2, 3)
SELECT model, effort, count(y - x) AS n, round(avg(y - x), 9) AS delta FROM side GROUP BY 1, 2"""
CASE_BARS = f"""{WIDE}, placed AS (SELECT *, row_number() OVER (PARTITION BY symbol, open_time <= 946684800000 ORDER BY open_time DESC) AS back, row_number() OVER (PARTITION BY symbol, open_time <= 946684800000 ORDER BY open_time) AS ahead, open_time <= 946684800000 AS before FROM bars),
vis AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS i FROM placed WHERE before AND back <= 60)"""
TARGETS = "[333.33, 9999.1, 88000.0, 0.00317, 555555.0, 0.314]::DOUBLE[]"
ANALYSES = "an AS (SELECT o_orderkey % 2000 AS analysis_id, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS logged_at, o_orderpriority AS model FROM orders)"
STATE = """st AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN 'running' WHEN o_orderkey % 4 = 1 THEN 'succeeded' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN 'analyst' END AS stage, 'analyst' AS next_stage, CAST(o_orderkey % 4 AS INT) AS attempt,
  o_orderkey % 2 = 0 AS found, o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 AS half, o_orderkey % 10 = 0 AS done FROM orders),
rec AS (SELECT run_id, CASE WHEN done THEN 'succeeded' WHEN half THEN 'pending' WHEN found THEN 'failed' WHEN status = 'running' THEN 'pending' ELSE status END AS status, CASE WHEN done OR half THEN 'judge' ELSE stage END AS stage,
  CASE WHEN done THEN NULL WHEN half THEN 'judge' WHEN found THEN next_stage WHEN status = 'running' THEN coalesce(stage, 'analyst') ELSE next_stage END AS next_stage, attempt FROM st)"""
POSITIONS = """pos AS (SELECT o_orderkey % 5 AS portfolio, o_orderkey AS id, o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, 1.0::DOUBLE + o_orderkey % 5 AS size, o_totalprice AS entry_price,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice * (0.9::DOUBLE + (o_orderkey % 5) * 0.05::DOUBLE) END AS exit_price, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status FROM orders),
p AS (SELECT *, CASE WHEN status = 'closed' THEN CASE WHEN side = 'long' THEN (exit_price - entry_price) * size ELSE (entry_price - exit_price) * size END END AS realized_pnl FROM pos)"""
_DIMS = [("structure", 11, 0.15), ("phase", 13, 0.15), ("event", 17, 0.15), ("direction", 2, 0.15), ("trigger", 3, 0.10), ("invalidation", 5, 0.10), ("narrative_quality", 19, 0.10), ("calibration", 23, 0.10)]


def _weighted_sql(names: list[str]) -> str:
    of = {n: (m, w) for n, m, w in _DIMS}
    score = lambda n: f"(CASE WHEN {'k % 7 <> 0' if n in ev.DETERMINISTIC else 'k % 29 <> 0' if n == 'calibration' else 'true'} THEN (k % {of[n][0]}) / {of[n][0]}.0::DOUBLE END)"
    top = " + ".join(f"coalesce({score(n)} * {of[n][1]}::DOUBLE, 0)" for n in names)
    bottom = " + ".join(f"CASE WHEN {score(n)} IS NULL THEN 0 ELSE {of[n][1]}::DOUBLE END" for n in names)
    return f"CASE WHEN ({bottom}) > 0 THEN round(({top}) / ({bottom}), 9) END"


SQL = {
    "b15_provenance_problems": """WITH p AS (SELECT doc_id AS k, 'raw/crypto_archive/posts/d' || doc_id || '.md' AS path, string_split('# Head' || chr(10) || replace(replace(split_part(coalesce(text, ''), chr(10), 1), '!', '.'), chr(13), '.') || chr(10) || '![chart](../images/i' || (doc_id % 50) || '.png)' || chr(10) || 'See ![x](http://h/i.png)' || chr(10) || 'end', chr(10)) AS ls FROM documents),
      a AS (SELECT k, CASE WHEN k % 17 = 0 THEN 'raw/crypto_archive/images/i' || (k % 50 + 1) || '.png' WHEN k % 19 = 0 THEN 'raw/other/i1.png' ELSE 'raw/crypto_archive/posts/../images/i' || (k % 50) || '.png' END AS img, 1 + k % 5 AS st, k % 5 + k % 4 AS en FROM p),
      x AS (SELECT p.k, replace(img, 'posts/../', '') AS img, st, en, ls, (k % 13) = 0 AS rooted FROM p JOIN a USING (k)),
      y AS (SELECT *, list_transform(regexp_extract_all(array_to_string(list_slice(ls, st, en), chr(10)), '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1), lambda r: 'raw/crypto_archive/' || replace(r, '../', '')) AS refs FROM x)
      SELECT 'c' || k AS case_id, CASE WHEN k % 7 = 0 THEN 'provenance_missing' WHEN k % 11 = 0 THEN 'expert_phase_empty' WHEN rooted THEN 'source_path_outside' WHEN img NOT LIKE 'raw/crypto_archive/%' THEN 'image_path_outside' WHEN k % 23 = 0 THEN 'source_path_not_there' WHEN regexp_extract(img, 'i([0-9]+)', 1)::INT > 45 THEN 'image_path_not_there'
        WHEN en < st THEN 'excerpt_order' WHEN en > len(ls) THEN 'excerpt_beyond_file' WHEN NOT list_contains(refs, img) THEN 'image_not_referenced' END AS problem FROM y""",
    "b05_score_forecasts": f"""WITH {HOURLY}, ix AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS i FROM bars),
      f AS (SELECT e.event_id AS id, e.event_type AS symbol, ts, CASE WHEN event_id % 35 = 0 THEN 'none' WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS said, CASE WHEN event_id % 2 = 0 THEN value * 1.5 ELSE value * 0.5 END AS trig, CASE WHEN event_id % 2 = 0 THEN value * 0.5 ELSE value * 1.5 END AS inval,
        (event_id % 100) / 100.0 AS conf, event_id % 45 = 0 AS retro, CASE WHEN event_id % 25 = 0 THEN NULL ELSE event_id % 20 <> 0 END AS decisive, CASE WHEN event_id % 15 = 0 THEN NULL WHEN event_id % 10 = 0 THEN 'up' ELSE 'none' END AS real FROM events e),
      s AS (SELECT f.*, ix.i AS at, NOT retro AND coalesce(NOT decisive, false) AND said = 'none' AND conf <= 0.35 AS wait_case FROM f ASOF JOIN ix ON f.symbol = ix.symbol AND epoch_ms(f.ts) < ix.open_time),
      m AS (SELECT id, min_by(hit, k) AS hit, min(k) AS k FROM (SELECT s.id, ix.i - s.at + 1 AS k, CASE said WHEN 'up' THEN CASE WHEN low <= inval THEN 'hit_sl' WHEN high >= trig THEN 'hit_tp' END WHEN 'down' THEN CASE WHEN high >= inval THEN 'hit_sl' WHEN low <= trig THEN 'hit_tp' END END AS hit
        FROM s JOIN ix ON ix.symbol = s.symbol AND ix.i >= s.at AND ix.i < s.at + 10 WHERE NOT retro AND NOT wait_case) WHERE hit IS NOT NULL GROUP BY id),
      r AS (SELECT s.*, m.hit, m.k, coalesce(real, CASE WHEN m.hit = 'hit_tp' THEN said ELSE 'none' END) AS rd, NOT retro AND NOT wait_case AS scored FROM s LEFT JOIN m USING (id))
      SELECT id, CASE WHEN scored THEN coalesce(hit, 'open') END AS outcome, CASE WHEN scored THEN k END AS bars_to_resolution, wait_case, scored AND real IS NULL AS used_fallback, CASE WHEN scored THEN CASE WHEN said = rd THEN 1.0 ELSE 0.0 END END AS direction,
        CASE WHEN scored THEN CASE WHEN coalesce(hit = 'hit_tp', false) THEN 1.0 ELSE 0.0 END END AS trigger, CASE WHEN scored THEN CASE WHEN coalesce(hit = 'hit_sl', false) THEN 0.0 ELSE 1.0 END END AS invalidation FROM r""",
    "b11_anonymised_snapshots": f"""WITH {CASE_BARS}, c AS (SELECT symbol, round(({TARGETS})[1 + CAST(('0x' || substr(sha256(symbol), 1, 8))::BIGINT % 6 AS INT)] / median(close), 8) AS coef FROM vis GROUP BY symbol)
      SELECT symbol AS case_id, i * 86400000 AS open_time, round(open * coef, 6) AS open, round(close * coef, 6) AS close FROM vis JOIN c USING (symbol)""",
    "b13_future_visible": f"WITH {CASE_BARS} SELECT symbol AS case_id, count(*) AS n, 59 * 86400000::BIGINT AS first, (58 + count(*)) * 86400000::BIGINT AS last FROM placed WHERE (before AND back = 1) OR (NOT before AND ahead <= 10) GROUP BY symbol",
    "b12_revealed": f"WITH {CASE_BARS} SELECT symbol AS case_id, count(*) AS n, min(open_time) AS first, round(sum(round(close, 4)), 1) AS close FROM vis GROUP BY symbol",
    "a15_combined_scores": f"SELECT k AS id, coalesce({_weighted_sql([n for n, _, _ in _DIMS])}, 0) AS aggregate, {_weighted_sql(ev.SEMANTIC)} AS expert_alignment, {_weighted_sql(ev.DETERMINISTIC)} AS realized_outcome, k % 29 <> 0 AS verdict_ok FROM (SELECT o_orderkey AS k FROM orders)",
    "j11_run_matrix": f"""WITH {ROWS}, angles(control, t, a, suffix) AS (VALUES ('baseline', 'blind', 'anon', ''), ('leakage', 'blind', 'revealed', '__revealed'), ('lookahead', 'future_visible', 'anon', '__fv'))
      SELECT concat_ws('__', case_id, t, a, model, effort) AS run_id, case_id, control, case_id || suffix AS snapshot_name FROM (SELECT DISTINCT case_id FROM rows), angles, (SELECT DISTINCT model, effort FROM rows) WHERE control = 'baseline' OR (model = 'BUILDING' AND effort = '1-URGENT')""",
    "s11_parse_run_ids": f"""WITH {ROWS} SELECT seq, CASE WHEN seq % 9 = 0 THEN concat_ws('__', case_id, model) ELSE concat_ws('__', case_id, time_mode, anon_mode, model, effort) END AS run_id, seq % 9 <> 0 AS run_ok, CASE WHEN seq % 9 <> 0 THEN case_id END AS case_id, CASE WHEN seq % 9 <> 0 THEN time_mode END AS time_mode,
      CASE WHEN seq % 9 <> 0 THEN anon_mode END AS anon_mode, CASE WHEN seq % 9 <> 0 THEN model END AS model, CASE WHEN seq % 9 <> 0 THEN effort END AS effort FROM rows""",
    "j09_ingest_skips": f"WITH {ROWS} SELECT CASE WHEN seq % 6 = 0 THEN 'unfilled' WHEN seq % 5 = 0 THEN 'no_spec' WHEN CAST(case_id AS INT) % 10 = 3 THEN 'no_answer_key' ELSE 'scored' END AS reason, count(*) AS n FROM rows GROUP BY 1",
    "f19_costs": f"WITH {COSTED} SELECT seq, total_tokens, round(cost_usd, 6) AS cost_usd, round(roi, 9) AS roi, roi_basis FROM roid",
    "a17_group_report": f"WITH {GROUPS} SELECT model, effort, n, round(a, 9) AS mean_aggregate, round(e, 9) AS mean_expert_alignment, round(r, 9) AS mean_realized_outcome, round(t, 9) AS mean_total_tokens, roi_basis FROM g",
    "a17_event_means": f"WITH {ROWS} SELECT model, effort, event_type, count(*) AS n, round(avg(aggregate), 9) AS mean_aggregate FROM rows WHERE time_mode = 'blind' AND anon_mode = 'anon' GROUP BY 1, 2, 3",
    "o03_ranks": f"WITH {GROUPS} SELECT model, effort, CAST(row_number() OVER (ORDER BY round(a, 9) DESC NULLS LAST, model, effort) AS INT) AS rank_aggregate, CAST(row_number() OVER (PARTITION BY roi_basis ORDER BY round(roi, 9) DESC NULLS LAST, model, effort) AS INT) AS rank_roi FROM g",
    "a20_delta_leakage": "WITH " + DELTA.replace("{to}", "time_mode = 'blind' AND anon_mode = 'revealed'"),
    "a20_delta_lookahead": "WITH " + DELTA.replace("{to}", "time_mode = 'future_visible' AND anon_mode = 'anon'"),
    "b18_reconcile_runs": f"WITH {STATE} SELECT * FROM rec",
    "b18_claimable_runs": f"WITH {STATE} SELECT run_id, coalesce(next_stage, stage, 'analyst') AS stage FROM rec WHERE status NOT IN ('succeeded', 'skipped', 'running') AND attempt < 3",
    "b15_case_problems": """WITH k AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT CASE WHEN k % 37 = 0 THEN 'c0' ELSE 'c' || k END AS case_id, CASE WHEN k % 13 = 0 THEN ' ' ELSE 'BTC' END AS symbol, k % 17 AS n_bars FROM k),
      a AS (SELECT 'c' || k AS case_id, CASE WHEN k % 7 = 0 THEN 'guess' WHEN k % 3 = 0 THEN 'retrospective' ELSE 'forward_looking' END AS mode, CASE WHEN k % 6 = 0 THEN 'not_applicable' ELSE 'up' END AS rd, CASE WHEN k % 19 = 0 THEN '' ELSE 'x' END AS gt FROM k WHERE k % 11 <> 0)
      SELECT c.case_id, CASE WHEN trim(symbol) = '' THEN 'symbol_empty' WHEN n_bars <= 0 THEN 'n_bars_not_positive' WHEN a.mode IS NULL THEN 'answer_missing' WHEN mode = 'guess' THEN 'analysis_mode_unknown' WHEN mode = 'retrospective' AND rd <> 'not_applicable' THEN 'retrospective_direction'
        WHEN mode = 'forward_looking' AND rd = 'not_applicable' THEN 'forward_direction' WHEN gt = '' THEN 'ground_truth_empty' WHEN count(*) OVER (PARTITION BY c.case_id) > 1 THEN 'case_id_repeated' END AS problem FROM c LEFT JOIN a USING (case_id)""",
    "f18_case_index": "SELECT c_custkey, CAST(('0x' || substr(sha256(c_name), 1, 8))::BIGINT % 6 AS INT) AS place FROM customer",
    "p02_list_analyses": f"WITH {ANALYSES} SELECT analysis_id, seq, logged_at FROM an WHERE logged_at BETWEEN '1996-01-01T00:00:00Z' AND '1996-06-30T00:00:00Z' AND model = '1-URGENT'",
    "p06_last_analysis": f"WITH {ANALYSES} SELECT analysis_id, max(seq) AS seq, arg_max(model, seq) AS model FROM an GROUP BY 1",
    "p06_first_signal": f"WITH {ANALYSES} SELECT analysis_id, seq, month FROM (SELECT *, substr(logged_at, 1, 7) AS month, row_number() OVER (PARTITION BY analysis_id ORDER BY substr(logged_at, 1, 7) DESC, seq) AS rn FROM an) WHERE rn = 1",
    "j07_latest_reviews": f"""WITH {ANALYSES}, l AS (SELECT analysis_id, arg_max(model, seq) AS model FROM an GROUP BY 1), r AS (SELECT user_id AS analysis_id, arg_max(row(event_type, event_id % 2 = 0), row(date_trunc('day', ts), event_id)) AS x FROM events GROUP BY 1)
      SELECT analysis_id, model, x[1] AS realized_direction, x[2] AS hit_trigger FROM l LEFT JOIN r USING (analysis_id)""",
    "k03_accepted_reviews": f"WITH {ANALYSES} SELECT user_id AS analysis_id, count(*) AS n FROM events WHERE user_id IN (SELECT analysis_id FROM an WHERE analysis_id % 3 = 0) GROUP BY 1",
    "k01_signal_problems": "SELECT CASE WHEN event_id % 9 = 0 THEN 'symbol' WHEN event_id % 11 = 0 THEN 'signal_type' WHEN event_id % 6 = 0 THEN 'entry_zone' WHEN event_id % 13 = 0 THEN 'logged_at' ELSE 'none' END AS problem, count(*) AS n FROM events GROUP BY 1",
    "b10_positions": f"WITH {POSITIONS} SELECT portfolio, id, symbol, side, size, entry_price, exit_price, status, realized_pnl FROM p",
    "a13_portfolio_state": f"""WITH {POSITIONS}, m AS (SELECT o_orderpriority AS symbol, max(o_totalprice) AS mark FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1), j AS (SELECT p.*, CASE WHEN status = 'open' THEN coalesce(CASE WHEN side = 'long' THEN (mark - entry_price) * size ELSE (entry_price - mark) * size END, 0) ELSE 0 END AS live FROM p LEFT JOIN m USING (symbol))
      SELECT portfolio, CAST(count(*) FILTER (status = 'closed') AS BIGINT) AS closed_count, CAST(count(*) FILTER (status = 'open') AS BIGINT) AS open_count, round(coalesce(sum(realized_pnl), 0), 2) AS realized, round(sum(live), 2) AS unrealized, round(100000 + coalesce(sum(realized_pnl), 0), 2) AS cash, round(100000 + coalesce(sum(realized_pnl), 0) + sum(live), 2) AS equity FROM j GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in SQL}
