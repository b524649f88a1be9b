"""Compiled schemas against a plain validator over random JSON, and the runs that rest on them."""

from __future__ import annotations

import copy
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import schemas
from tidemark.operators import runs

KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def follows(v, s, root):
    """A plain validator of the same keywords."""
    if isinstance(s, bool):
        return s
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    is_ = lambda t: number if t == "number" else number and v == int(v) if t == "integer" else isinstance(v, KINDS[t])
    same = lambda a, b: type(a) is type(b) and a == b or (not isinstance(a, bool) and not isinstance(b, bool) and isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b)
    tests = [
        "type" not in s or any(is_(t) for t in ([s["type"]] if isinstance(s["type"], str) else s["type"])), "enum" not in s or any(same(v, x) for x in s["enum"]), "const" not in s or same(v, s["const"]),
        "anyOf" not in s or any(follows(v, x, root) for x in s["anyOf"]), all(follows(v, x, root) for x in s.get("allOf", [])), "$ref" not in s or follows(v, root["$defs"][s["$ref"].split("/")[-1]], root),
    ]
    if number:
        tests += [v >= s.get("minimum", v), v <= s.get("maximum", v), "exclusiveMinimum" not in s or v > s["exclusiveMinimum"], "exclusiveMaximum" not in s or v < s["exclusiveMaximum"]]
    if isinstance(v, str):
        tests += [len(v) >= s.get("minLength", 0), len(v) <= s.get("maxLength", 10**9), "pattern" not in s or re.search(s["pattern"], v) is not None]
    if isinstance(v, list):
        tests += [len(v) >= s.get("minItems", 0), len(v) <= s.get("maxItems", 10**9), "items" not in s or all(follows(x, s["items"], root) for x in v)]
    if isinstance(v, dict):
        known = s.get("properties", {})
        tests += [all(k in v for k in s.get("required", [])), all(follows(v[k], x, root) for k, x in known.items() if k in v), "additionalProperties" not in s or all(follows(x, s["additionalProperties"], root) for k, x in v.items() if k not in known)]
    return all(tests)


def value(r, depth=0):
    plain = [None, True, False, 0, 1, -3, 2.5, 0.5, "", "a", "é🌊", "up", "none", 10]
    if depth > 2 or r.random() < 0.5:
        return r.choice(plain)
    if r.random() < 0.5:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {k: value(r, depth + 1) for k in r.sample(["a", "b", "c", "d"], r.randint(0, 4))}


SCHEMAS = [
    {"type": "object", "required": ["a"], "properties": {"a": {"type": ["number", "null"], "minimum": 0, "exclusiveMaximum": 10}, "b": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "minLength": 1}}}, "additionalProperties": False},
    {"type": "array", "items": {"anyOf": [{"type": "integer"}, {"enum": ["up", None, True]}, {"$ref": "#/$defs/x"}]}, "$defs": {"x": {"type": "object", "additionalProperties": {"type": "boolean"}}}},
    {"allOf": [{"maximum": 1}, {"maxLength": 1}, {"pattern": "^[a-zé]"}, {"required": ["b", "c"]}]},
    {"properties": {"a": {"type": "object", "properties": {"a": {"const": 1}}, "required": ["a"]}}, "exclusiveMinimum": 0, "title": "t"},
    {"type": "integer"},
]


def test_compiled_schemas_equal_a_plain_validator(spark):
    r = random.Random(4)
    values = [value(r) for _ in range(900)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, "{oops"), (-2, None), (-3, '{"a": 1, "a": 2}')], "i int, j string")
    for s in SCHEMAS:
        got = {x.i: x.ok for x in df.select("i", schemas.valid_json(F.col("j"), s).alias("ok")).collect()}
        assert not got[-1] and not got[-2] and not got[-3]
        assert {i: got[i] for i in range(900)} == {i: follows(v, s, s) for i, v in enumerate(values)}, s
        assert len({got[i] for i in range(900)}) == 2


def test_unknown_keywords_are_refused():
    for s in ({"uniqueItems": True}, {"properties": {"a": {"format": "date"}}}):
        with pytest.raises(ValueError, match="unknown keyword"):
            schemas._checked(F.col("x"), s, s, 0)
    loop = {"$ref": "#/$defs/x", "$defs": {"x": {"items": {"$ref": "#/$defs/x"}}}}
    with pytest.raises(ValueError, match="refers to itself"):
        schemas._checked(F.col("x"), loop, loop, 0)


GOOD = {"narrative": "n", "evidence": ["e"], "direction": "up", "trigger": None, "invalidation": 1.5, "confidence": 1, "structure": "s", "phase": "p", "event": "e"}
JUDGED = {d: {"score": 0.5, "rationale": ""} for d in runs.JUDGED}


def test_result_validity(spark):
    def but(base, **changes):
        made = copy.deepcopy(base)
        for k, v in changes.items():
            made.pop(k) if v is ... else made.__setitem__(k, v)
        return made

    cases = [
        ({"analysis_output": GOOD, "judge_verdict": JUDGED}, True, True), ({"analysis_output": GOOD, "judge_verdict": None}, True, False), ({"analysis_output": GOOD}, True, False), ({"judge_verdict": JUDGED}, False, False),
        ({"analysis_output": GOOD, "judge_verdict": but(JUDGED, phase=...)}, False, False), ({"analysis_output": GOOD, "judge_verdict": but(JUDGED, phase={"score": 2, "rationale": ""})}, False, False), ({"analysis_output": GOOD, "judge_verdict": 5}, False, False),
        *(({"analysis_output": but(GOOD, **{k: v}), "judge_verdict": JUDGED}, False, False) for k, v in (("direction", "sideways"), ("evidence", []), ("evidence", [""]), ("confidence", 1.01), ("confidence", True), ("trigger", "1"), ("phase", ""), ("event", ...), ("odd", 1), ("forecast", []))),
        ({"analysis_output": but(GOOD, forecast={"x": 1}, notes=""), "judge_verdict": JUDGED}, True, True), ([1], False, False),
    ]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)] + [(99, "{"), (98, None)], "run_id int, raw string")
    got = {x.run_id: (x.analyst_ok, x.complete) for x in runs.result_validity(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)} | {99: (False, False), 98: (False, False)}


def test_fingerprint_of_a_list_of_specs(spark):
    specs = [{"run_id": f"r{k}", "case_id": "c", "model": "m", "effort": None if k % 2 else "high", "missing_snapshot": bool(k % 3)} for k in range(7)]
    df = spark.createDataFrame([(k, *s.values()) for k, s in enumerate(specs)], "run_no int, run_id string, case_id string, model string, effort string, missing_snapshot boolean").repartition(3)
    want = [{k: s[k] for k in sorted(s) if k != "missing_snapshot"} for s in specs]
    assert runs.manifest_fingerprint(df) == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert runs.manifest_fingerprint(df.withColumn("missing_snapshot", F.lit(True))) == runs.manifest_fingerprint(df) != runs.manifest_fingerprint(df.withColumn("run_no", -F.col("run_no")))


def test_states_of_another_matrix_are_refused(spark):
    specs = spark.createDataFrame([("a", "codex"), ("b", "opus"), ("c", "opus")], "run_id string, model string")
    first = runs.initialised(None, specs.limit(2), "f1", None)
    with pytest.raises(ValueError, match="another run matrix"):
        runs.initialised(first, specs, "f2", "f1")
    taken = runs.claimed(first, specs.where("run_id = 'a'"), 3)
    again = {x.run_id: x for x in runs.initialised(taken, specs, "f1", "f1").collect()}
    assert (again["a"].status, again["a"].attempt, again["a"].provider, again["c"].status, again["b"].provider) == ("running", 1, "codex", "pending", "claude")
    assert runs.initialised(taken, specs, "f2", "f1", reset=True).where("status = 'pending' and attempt = 0").count() == 3


def test_states_after_a_look_at_results(spark):
    state = spark.createDataFrame([("done", "running", "judge", "judge", 1, None), ("half", "running", "analyst", "analyst", 1, "x"), ("bad", "running", "analyst", "analyst", 1, None), ("stale", "running", None, "q", 1, None), ("new", "pending", "analyst", "analyst", 2, None)], "run_id string, status string, stage string, next_stage string, attempt int, error string")
    results = spark.createDataFrame([("done", True, True), ("half", True, False), ("bad", False, False)], "run_id string, analyst_ok boolean, complete boolean")
    after = runs.reconciled(state, results)
    got = {x.run_id: (x.status, x.stage, x.next_stage, x.attempt, x.error) for x in after.collect()}
    assert got == {"done": ("succeeded", "judge", None, 1, None), "half": ("pending", "judge", "judge", 1, None), "bad": ("failed", "analyst", "analyst", 1, "corrupt_result"), "stale": ("pending", None, "analyst", 1, "stale_running"), "new": ("pending", "analyst", "analyst", 2, None)}
    claimed = {x.run_id: (x.status, x.stage, x.attempt, x.error) for x in runs.claimed(after, state, 2).collect()}
    assert claimed == {"done": ("succeeded", "judge", 1, None), "half": ("running", "judge", 2, None), "bad": ("running", "analyst", 2, None), "stale": ("running", "analyst", 2, None), "new": ("pending", "analyst", 2, None)}


def test_events_without_cases(spark):
    answers = spark.createDataFrame([("c1", "spring"), ("c2", "spring"), ("c3", "test")], "case_id string, event_type string")
    got = lambda **k: {(x.event_type, x.n) for x in runs.uncovered(answers, ["spring", "test", "upthrust"], **k).collect()}
    assert got() == {("upthrust", 0)} and got(least=2) == {("upthrust", 0), ("test", 1)}
