"""Artifacts of readings, image files by content, and what readings say against cards."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.operators import ocr

GENERATOR = {"parser_version": 10, "minimum_confidence": 0.85, "runs_per_image": 2, "engine": ocr.ENGINE, "recognition_language": "en-US", "uses_language_correction": False, "toolchain": {}}


def reading(value, eligible=True, runs=None, members=None):
    made = {"value": value, "decision_eligible": eligible, "runs": [value, value] if runs is None else runs, "evidence": [[], []]}
    return made if members is None else made | {"members": members, "members_decision_eligible": True, "member_runs": [members, members], "member_evidence": [[], []]}


def artifact(*images, **changes):
    return json.dumps({"schema": ocr.SCHEMA, "generator": GENERATOR, "images": list(images)} | changes)


def test_contract(spark):
    bad = lambda **c: GENERATOR | c
    cases = {
        artifact(): None, artifact({"image_path": "a"}, {"image_path": "b"}): None, "{": "not_json", "[]": "contract", artifact(schema="other"): "contract", artifact(images={}): "contract", artifact({"image_path": ""}): "contract", artifact("a"): "contract",
        artifact({"image_path": "a"}, {"image_path": "a"}): "repeated_image", artifact(generator=None): "contract",
        **{artifact(generator=bad(**{k: v})): "contract" for k, v in (("parser_version", 9), ("parser_version", "10"), ("minimum_confidence", 0.8), ("runs_per_image", 3), ("engine", "x"), ("recognition_language", "de"), ("uses_language_correction", True), ("toolchain", []))},
    }
    df = spark.createDataFrame([(t,) for t in cases], "payload string")
    assert {r.payload: r.problem for r in ocr.artifact_problem(df).collect()} == cases


def test_observations(spark):
    images = [
        {"image_path": "a", "sha256": "x", "asset": reading("BTC", members=["BTC", "Eth"]), "timeframe": reading("daily")}, {"image_path": "b", "asset": reading("Unknown"), "timeframe": reading("4 hr", runs=["4 hr", "daily"])},
        {"image_path": "c", "asset": reading("BTC", eligible=False), "timeframe": reading(5)}, {"image_path": "d", "asset": reading("X", members=["A", "a"])}, {"image_path": "e", "asset": reading("X", runs=["X"]), "timeframe": reading("") | {"evidence": [[]]}},
    ]
    df = spark.createDataFrame([(artifact(*images),), ("{",)], "payload string")
    got = {r.image_path: (r.sha256, r.asset, r.timeframe, r.members, r.has_members) for r in ocr.observations(df).collect()}
    assert got == {"a": ("x", "BTC", "daily", ["BTC", "ETH"], True), "b": (None, None, None, None, False), "c": (None, None, None, None, False), "d": (None, "X", None, None, True), "e": (None, None, None, None, False)}


def test_findings(spark, tmp_path):
    folder = "raw/bruce_fraser/images"
    (tmp_path / folder / "deep").mkdir(parents=True)
    for name in ("one.png", "old.png", "deep/two.png", "lone.png"):
        (tmp_path / folder / name).write_bytes(b"\x89PNG\xff" + name.encode())
    at = lambda name: f"{folder}/{name}"
    sha = lambda name: hashlib.sha256(b"\x89PNG\xff" + name.encode()).hexdigest()
    files = ocr.image_files(spark, str(tmp_path), folder)
    assert {r.image_path: r.actual for r in files.collect()} == {at(n): sha(n) for n in ("one.png", "old.png", "deep/two.png", "lone.png")}
    images = [
        {"image_path": at("one.png"), "sha256": sha("one.png"), "asset": reading("BTC"), "timeframe": reading("4 hr")}, {"image_path": at("old.png"), "sha256": "0" * 64, "asset": reading("BTC")},
        {"image_path": at("deep/two.png"), "sha256": sha("deep/two.png"), "asset": reading("DJIA", members=["INDU", "SPX"])}, {"image_path": at("gone.png"), "sha256": "0" * 64, "asset": reading("BTC")},
    ]
    fraser = "raw/bruce_fraser/posts/p.md"
    rows = [
        ("a", fraser, "one.png", "btc", "4-hour"), ("b", fraser, "one.png", "ETH", "daily"), ("c", fraser, "one.png", "unknown", ""), ("d", fraser, "one.png", "ETH and BTC", "quarterly"), ("e", "raw/crypto_archive/posts/p.md", "one.png", "ETH", "daily"),
        ("g", fraser, "old.png", "ETH", "daily"), ("f", fraser, "old.png", "ETH", "daily"), ("h", fraser, "deep/two.png", "SPX / DJIA", "x"), ("i", fraser, "deep/two.png", "SPX, NDX", "x"), ("j", fraser, "gone.png", "ETH", "x"), ("k", fraser, "lone.png", "ETH", "x"), ("l", fraser, "deep/two.png", "SPX&DJIA", "x"),
    ]
    cards = spark.createDataFrame([(p, s, at(i), a, t) for p, s, i, a, t in rows], "path string, source string, image_path string, asset string, timeframe string")
    seen = ocr.observations(spark.createDataFrame([(artifact(*images),)], "payload string"))
    got = {(r.path, r.code, r.field) for r in ocr.evidence_findings(cards, seen, files).collect()}
    assert got == {("b", ocr.CONTRADICTION, "asset"), ("b", ocr.CONTRADICTION, "timeframe"), ("f", ocr.STALE, None), ("i", ocr.CONTRADICTION, "asset"), ("l", ocr.CONTRADICTION, "asset")}


def test_declared_assets(spark):
    want = {"BTC / ETH": ["BTC", "ETH"], "A&B": ["AB"], "a AND b, c": ["A", "B", "C"], "Sandy": ["SANDY"], "INDU & SPX": ["DJIA", "SPX"], "x / -": ["", "X"], "": []}
    df = spark.createDataFrame([(k,) for k in want], "x string")
    assert {r.x: r.y for r in df.select("x", values.asset_parts(F.col("x")).alias("y")).collect()} == want
