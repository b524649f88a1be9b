"""Queries over evaluation runs: results held to their schemas, fingerprints, and states; made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, runs
from .common import table


def _results(spark: SparkSession, d: str) -> DataFrame:
    """A result's JSON text for each order, broken in many ways by key."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    some = lambda n, text, other="": F.when(k % n == 0, F.lit(text)).otherwise(F.lit(other))
    analysis = F.concat(
        F.lit('{"narrative": "'), "o_orderstatus", F.lit('", "evidence": '), F.when(k % 11 == 0, "[]").when(k % 13 == 0, "[1]").otherwise('["e", "é"]'), F.lit(', "direction": "'), some(5, "sideways", "up"), F.lit('", "trigger": '), F.when(k % 17 == 0, '"1"').when(k % 2 == 0, "null").otherwise("1.5"),
        F.lit(', "invalidation": 2, "confidence": '), ((k % 10) / 8.0).cast("string"), F.lit(', "structure": "s", '), some(23, "", '"phase": "p", '), F.lit('"event": "e"'), some(19, ', "odd": {"x": [1]}'), F.lit("}"),
    )
    dim = lambda name: F.concat(F.lit(f'"{name}": {{"score": '), some(29, "2", "0.5"), F.lit(', "rationale": "r"'), some(37, ', "more": 1'), F.lit("}"))
    verdict = F.concat(F.lit("{"), F.concat_ws(", ", *(dim(n) for n in runs.JUDGED[:4])), F.when(k % 31 == 0, "").otherwise(F.concat(F.lit(", "), dim("calibration"))), F.lit("}"))
    judged = F.when(k % 3 == 0, ', "judge_verdict": null').when(k % 3 == 1, F.concat(F.lit(', "judge_verdict": '), verdict)).otherwise("")
    whole = F.concat(F.lit('{"analysis_output": '), analysis, judged, F.lit("}"))
    return o.select(k.alias("run_id"), F.when(k % 41 == 0, F.substring(whole, 1, 60)).otherwise(whole).alias("raw"))


def h13_result_validity(spark: SparkSession, d: str) -> DataFrame:
    return runs.result_validity(_results(spark, d)).select("run_id", "analyst_ok", "complete")


def _state(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(k.alias("run_id"), F.when(k % 4 == 0, "running").when(k % 4 == 1, "succeeded").otherwise("pending").alias("status"), F.when(k % 3 != 0, "analyst").alias("stage"), F.when(k % 9 != 0, "analyst").alias("next_stage"), (k % 4).cast("int").alias("attempt"), F.lit("claude").alias("provider"), F.lit(None).cast("string").alias("error"))


def b18_claimed_runs(spark: SparkSession, d: str) -> DataFrame:
    """States held to the results of every second run, then every third run claimed."""
    results = runs.result_validity(_results(spark, d).where("run_id % 2 = 0"))
    asked = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("run_id"))
    return runs.claimed(runs.reconciled(_state(spark, d), results), asked, 3).drop("provider")


def h14_initialised_runs(spark: SparkSession, d: str) -> DataFrame:
    """States of two thirds of the runs, carried on over the whole matrix."""
    specs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 5 == 0, "codex").otherwise("opus").alias("model"))
    return runs.initialised(_state(spark, d).where("run_id % 3 <> 1"), specs, "same", "same").select("run_id", "status", "stage", "attempt", "provider")


def f22_manifest_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The list of a matrix's specs, one for each customer, and the hash of what may not change in it."""
    specs = table(spark, d, "customer").select(F.col("c_custkey").alias("run_no"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("run_id"), F.col("c_mktsegment").alias("model"), F.when(F.col("c_custkey") % 3 != 0, "high").alias("effort"), (F.col("c_custkey") % 7 == 0).alias("missing_snapshot"))
    return spark.range(1).select(F.lit(runs.manifest_fingerprint(specs)).alias("fingerprint"))


EVENTS = [f"ev{n}" for n in range(4)]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """A result for each order: its forecast, verdict and usage as JSON, some lacking a part; a case for each customer, with five bars after its cutoff."""
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    up, quiet = k % 3 == 0, k % 3 == 2
    level = lambda up_by, down_by: F.when(up, 100.0 + up_by).otherwise(100.0 - down_by)
    said = F.struct(F.when(up, "Bullish").when(quiet, "none").otherwise("down").alias("direction"), level(k % 20, k % 20).alias("trigger"), level(-(k % 25), -(k % 25)).alias("invalidation"), (k % 10 / 10.0).alias("confidence"))
    judged = F.struct(*(F.struct(((k % n) / F.lit(float(n))).alias("score")).alias(dim) for dim, n in zip(runs.JUDGED, (3, 5, 7, 11), strict=False)), F.when(k % 31 != 0, F.struct((k % 13 / 13.0).alias("score"))).alias("calibration"))
    usage = F.struct((k % 2000 + 1).alias("input_tokens"), F.when(k % 17 != 0, k % 900 + 1).alias("output_tokens"))
    raw = F.when(k % 23 == 0, F.lit(None)).otherwise(F.to_json(F.struct(said.alias("analysis_output"), judged.alias("judge_verdict"), usage.alias("usage"))))
    results = o.select(k.cast("string").alias("run_id"), raw.alias("raw"))
    specs = o.where(k % 19 != 0).select(k.cast("string").alias("run_id"), c.cast("string").alias("case_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("effort"), F.lit("blind").alias("time_mode"), F.lit("anon").alias("anon_mode"))
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_custkey").cast("string").alias("case_id"))
    n = F.col("n")
    answers = cases.where(n % 10 != 3).select("case_id", F.concat(F.lit("ev"), n % 4).alias("event_type"), F.when(n % 5 == 0, "up").when(n % 5 == 1, "none").alias("realized_direction"), (n % 6 != 0).alias("decisive"), F.when(n % 8 == 0, "retrospective").otherwise("forward").alias("analysis_mode"))
    walk = cases.select("case_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"), "n").select("case_id", "i", (100.0 + F.col("i") * (n % 5)).alias("high"), (100.0 - F.col("i") * (n % 7)).alias("low"))
    prices = spark.createDataFrame([("1-URGENT", 3.0, 15.0), ("2-HIGH", 5.0, 25.0)], "model string, price_in double, price_out double")
    return runs.scored(results, specs, answers, walk, prices, digits=None)


def b08_scored_runs(spark: SparkSession, d: str) -> DataFrame:
    got = _scored(spark, d)
    return got.select("run_id", "case_id", "event_type", "skip", "outcome", "wait_case", "roi_basis", "total_tokens", *(F.round(c, 7).alias(c) for c in ("aggregate", "expert_alignment", "realized_outcome", "cost_usd", "roi")))


def b24_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The counters that come with the rows as they are written, without another pass."""
    rows, seen = runs.covered(_scored(spark, d), EVENTS)
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, int(v)) for k, v in sorted(seen.get.items())], "name string, n bigint")


DIMS = ", ".join(f"'{d}'" for d in runs.JUDGED)
KNOWN = ", ".join(f"'{p}'" for p in runs.ANALYSIS["properties"])
NEEDED = ", ".join(f"'{p}'" for p in runs.ANALYSIS["required"])
_DIM = "CASE WHEN o_orderkey % 29 = 0 THEN '2' ELSE '0.5' END || ', \"rationale\": \"r\"' || CASE WHEN o_orderkey % 37 = 0 THEN ', \"more\": 1' ELSE '' END || '}'"
_VERDICT = " || ', ' || ".join(f"'\"{d}\": {{\"score\": ' || {_DIM}" for d in runs.JUDGED[:4]) + f" || CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE ', \"calibration\": {{\"score\": ' || {_DIM} END"
#: The texts again, and the schemas' rules by JSON functions.
RESULTS = f"""w AS (SELECT o_orderkey AS run_id, '{{"analysis_output": {{"narrative": "' || o_orderstatus || '", "evidence": ' || CASE WHEN o_orderkey % 11 = 0 THEN '[]' WHEN o_orderkey % 13 = 0 THEN '[1]' ELSE '["e", "é"]' END || ', "direction": "' || CASE WHEN o_orderkey % 5 = 0 THEN 'sideways' ELSE 'up' END || '", "trigger": '
  || CASE WHEN o_orderkey % 17 = 0 THEN '"1"' WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '1.5' END || ', "invalidation": 2, "confidence": ' || CAST((o_orderkey % 10) / 8.0 AS VARCHAR) || ', "structure": "s", ' || CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE '"phase": "p", ' END || '"event": "e"' || CASE WHEN o_orderkey % 19 = 0 THEN ', "odd": {{"x": [1]}}' ELSE '' END || '}}'
  || CASE o_orderkey % 3 WHEN 0 THEN ', "judge_verdict": null' WHEN 1 THEN ', "judge_verdict": {{' || {_VERDICT} || '}}' ELSE '' END || '}}' AS whole FROM orders),
t AS (SELECT run_id, CASE WHEN run_id % 41 = 0 THEN substr(whole, 1, 60) ELSE whole END AS raw FROM w), j AS (SELECT run_id, CASE WHEN json_valid(raw) THEN json_extract(raw, '$.analysis_output') END AS a, CASE WHEN json_valid(raw) THEN json_extract(raw, '$.judge_verdict') END AS v FROM t),
num AS (SELECT ['BIGINT', 'UBIGINT', 'DOUBLE'] AS n),
c AS (SELECT run_id, coalesce(json_type(a) = 'OBJECT' AND list_has_all(json_keys(a), [{NEEDED}]) AND list_has_all([{KNOWN}], json_keys(a)) AND json_extract_string(a, '$.direction') IN ('up', 'down', 'none') AND list_contains(list_append(n, 'NULL'), json_type(a, '$.trigger')) AND list_contains(list_append(n, 'NULL'), json_type(a, '$.invalidation'))
    AND list_contains(n, json_type(a, '$.confidence')) AND CAST(json_extract(a, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1 AND json_type(a, '$.evidence') = 'ARRAY' AND json_array_length(a, '$.evidence') >= 1 AND len(list_filter(CAST(json_extract(a, '$.evidence') AS JSON[]), lambda e: json_type(e) <> 'VARCHAR')) = 0, false) AS ok,
  coalesce(json_type(v) <> 'NULL', false) AS judged, coalesce(json_type(v) = 'OBJECT' AND list_has_all(json_keys(v), [{DIMS}]) AND list_has_all([{DIMS}], json_keys(v)) AND len(list_filter([{DIMS}], lambda d: NOT (json_keys(v, '$.' || d) = ['score', 'rationale'] AND CAST(json_extract(v, '$.' || d || '.score') AS DOUBLE) BETWEEN 0 AND 1))) = 0, false) AS vok FROM j, num),
res AS (SELECT run_id, ok AND (NOT judged OR vok) AS analyst_ok, ok AND judged AND vok AS complete FROM c)"""
STATE = """st AS (SELECT o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'succeeded' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN 'analyst' END AS stage, CASE WHEN o_orderkey % 9 <> 0 THEN 'analyst' END AS next_stage, CAST(o_orderkey % 4 AS INT) AS attempt FROM orders)"""
_MEAN = lambda names: "(" + " + ".join(f"coalesce({n} * {evaluation.WEIGHTS[n]}, 0)" for n in names) + ") / nullif(" + " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {evaluation.WEIGHTS[n]} END" for n in names) + ", 0)"
SCORED = f"""r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS model, o_orderkey % 3 = 0 AS up, CASE o_orderkey % 3 WHEN 0 THEN 'up' WHEN 2 THEN 'none' ELSE 'down' END AS said, CASE WHEN o_orderkey % 3 = 0 THEN 100 + o_orderkey % 20 ELSE 100 - o_orderkey % 20 END AS trig, CASE WHEN o_orderkey % 3 = 0 THEN 100 - o_orderkey % 25 ELSE 100 + o_orderkey % 25 END AS inval,
  (o_orderkey % 10) / 10.0 AS conf, o_orderkey % 2000 + 1 AS ti, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 900 + 1 END AS tt, (o_orderkey % 3) / 3.0::DOUBLE AS structure, (o_orderkey % 5) / 5.0::DOUBLE AS phase, (o_orderkey % 7) / 7.0::DOUBLE AS event, (o_orderkey % 11) / 11.0::DOUBLE AS narrative_quality, (o_orderkey % 13) / 13.0::DOUBLE AS calibration FROM orders),
a AS (SELECT c_custkey AS c, 'ev' || (c_custkey % 4) AS event_type, CASE c_custkey % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'none' END AS rd, c_custkey % 6 <> 0 AS decisive, c_custkey % 8 = 0 AS retro FROM customer WHERE c_custkey % 10 <> 3),
j AS (SELECT r.*, k % 19 <> 0 AS has, a.event_type, a.rd, a.decisive, a.retro, CASE WHEN k % 23 = 0 THEN 'unfilled' WHEN k % 19 = 0 THEN 'no_spec' WHEN a.c IS NULL THEN 'no_answer_key' WHEN k % 31 = 0 THEN 'verdict' END AS skip FROM r LEFT JOIN a ON a.c = r.c AND k % 19 <> 0),
w AS (SELECT *, NOT retro AND NOT decisive AND said = 'none' AND conf <= 0.35 AS wait FROM j WHERE skip IS NULL),
m AS (SELECT k, min_by(hit, i) AS hit FROM (SELECT k, i, CASE said WHEN 'up' THEN CASE WHEN 100 - i * (c % 7) <= inval THEN 'hit_sl' WHEN 100 + i * (c % 5) >= trig THEN 'hit_tp' END WHEN 'down' THEN CASE WHEN 100 + i * (c % 5) >= inval THEN 'hit_sl' WHEN 100 - i * (c % 7) <= trig THEN 'hit_tp' END END AS hit FROM w, range(1, 6) t(i) WHERE NOT retro AND NOT wait) WHERE hit IS NOT NULL GROUP BY k),
v AS (SELECT w.*, CASE WHEN NOT retro AND NOT wait THEN coalesce(hit, 'open') END AS outcome, coalesce(rd, CASE WHEN hit = 'hit_tp' THEN said ELSE 'none' END) AS real FROM w LEFT JOIN m USING (k)),
x AS (SELECT *, CASE WHEN outcome IS NOT NULL THEN CASE WHEN said = real THEN 1.0 ELSE 0.0 END END AS direction, CASE WHEN outcome IS NOT NULL THEN CASE WHEN outcome = 'hit_tp' THEN 1.0 ELSE 0.0 END END AS trigger, CASE WHEN outcome IS NOT NULL THEN CASE WHEN outcome = 'hit_sl' THEN 0.0 ELSE 1.0 END END AS invalidation FROM v),
y AS (SELECT *, coalesce({_MEAN(list(evaluation.WEIGHTS))}, 0) AS agg, {_MEAN(evaluation.SEMANTIC)} AS ex, {_MEAN(evaluation.DETERMINISTIC)} AS re, ti + coalesce(tt, 0) AS total, CASE model WHEN '1-URGENT' THEN (ti * 3.0 + tt * 15.0) / 1000000 WHEN '2-HIGH' THEN (ti * 5.0 + tt * 25.0) / 1000000 END AS cost, model IN ('1-URGENT', '2-HIGH') AS usd FROM x)"""
SQL = {
    "b08_scored_runs": f"""WITH {SCORED} SELECT CAST(j.k AS VARCHAR) AS run_id, CASE WHEN j.has THEN CAST(j.c AS VARCHAR) END AS case_id, j.event_type, j.skip, y.outcome, y.wait AS wait_case, CASE WHEN y.usd THEN 'usd' WHEN y.k IS NOT NULL THEN 'tokens' END AS roi_basis, y.total AS total_tokens, round(agg, 7) AS aggregate, round(ex, 7) AS expert_alignment, round(re, 7) AS realized_outcome,
      round(cost, 7) AS cost_usd, round(CASE WHEN usd THEN agg / cost ELSE agg / (total / 1000.0) END, 7) AS roi FROM j LEFT JOIN y ON y.k = j.k""",
    "b24_coverage": f"""WITH {SCORED}, n AS (SELECT 'considered' AS name, count(*) AS n FROM j UNION ALL SELECT 'scored', count(*) FROM w UNION ALL SELECT s, count(*) FILTER (skip = s) FROM j, (VALUES ('unfilled'), ('no_spec'), ('no_answer_key'), ('verdict')) t(s) GROUP BY s
      UNION ALL SELECT 'event_' || e, count(*) FILTER (event_type = e) FROM w, (VALUES ('ev0'), ('ev1'), ('ev2'), ('ev3')) t(e) GROUP BY e) SELECT * FROM n""",
    "h13_result_validity": f"WITH {RESULTS} SELECT * FROM res",
    "b18_claimed_runs": f"""WITH {RESULTS}, {STATE}, r AS (SELECT *, true AS found FROM res WHERE run_id % 2 = 0), g AS (SELECT st.*, CASE WHEN complete THEN 'done' WHEN analyst_ok THEN 'half' WHEN found THEN 'bad' WHEN status = 'running' THEN 'stale' ELSE '' END AS w FROM st LEFT JOIN r USING (run_id)),
      a AS (SELECT run_id, CASE w WHEN 'done' THEN 'succeeded' WHEN 'bad' THEN 'failed' WHEN '' THEN status ELSE 'pending' END AS status, CASE WHEN w IN ('done', 'half') THEN 'judge' ELSE stage END AS stage, CASE w WHEN 'done' THEN NULL WHEN 'half' THEN 'judge' WHEN 'stale' THEN coalesce(stage, 'analyst') ELSE next_stage END AS next_stage, attempt,
        CASE w WHEN 'bad' THEN 'corrupt_result' WHEN 'stale' THEN 'stale_running' END AS error FROM g), f AS (SELECT *, run_id % 3 = 0 AND status NOT IN ('succeeded', 'running') AND attempt < 3 AS free FROM a)
      SELECT run_id, CASE WHEN free THEN 'running' ELSE status END AS status, CASE WHEN free THEN coalesce(next_stage, stage, 'analyst') ELSE stage END AS stage, next_stage, CASE WHEN free THEN attempt + 1 ELSE attempt END AS attempt, CASE WHEN NOT free THEN error END AS error FROM f""",
    "h14_initialised_runs": f"WITH {STATE} SELECT run_id, status, stage, attempt, 'claude' AS provider FROM st WHERE run_id % 3 <> 1 UNION ALL SELECT run_id, 'pending', 'analyst', 0, CASE WHEN run_id % 5 = 0 THEN 'codex' ELSE 'claude' END FROM st WHERE run_id % 3 = 1",
    "f22_manifest_fingerprint": """SELECT sha256('[' || string_agg('{"effort":' || CASE WHEN c_custkey % 3 <> 0 THEN '"high"' ELSE 'null' END || ',"model":"' || c_mktsegment || '","run_id":"r' || c_custkey || '"}', ',' ORDER BY c_custkey) || ']') AS fingerprint FROM customer""",
}
QUERIES = {name: globals()[name] for name in SQL}
