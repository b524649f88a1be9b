"""Proofs of answers: one case for each rule, in the order in which they are asked."""

from __future__ import annotations

from tidemark.operators import evaluation as ev

FIELDS = [f for f in (*ev.PROVENANCE, *ev.EXPERT_LABELS) if f != "source_excerpt_location"]
SCHEMA = "case_id string, " + ", ".join(f"{f} string" for f in FIELDS) + ", source_excerpt_location struct<start_line:int, end_line:int>"
POST = "# H\n\nText ![a](../images/v/a.png) and ![b]( ../images/b.png )\n![c](http://h/c.png)\n![d](../../crypto_archive/images/d.png)\n"


def test_rules_in_order(spark):
    good = dict.fromkeys(FIELDS, "not_stated") | {"source_path": "raw/crypto_archive/posts/p.md", "source_image_path": "raw/crypto_archive/images/v/a.png"}
    image = lambda x: {"source_image_path": f"raw/crypto_archive/images/{x}"}
    cases = {
        "ok": ({}, (3, 3), None), "all": ({}, (1, 5), None), "spaces": (image("b.png"), (2, 4), None), "up": (image("d.png"), (5, 5), None), "no_label": ({"expert_phase": None}, (3, 3), None), "dots": ({"source_path": "raw/x/../crypto_archive/posts/./p.md"}, (3, 3), None),
        "missing": ({"source_url": None}, (3, 3), "provenance_missing"), "no_place": ({}, None, "provenance_missing"), "empty": ({"expert_event": " ", "source_url": ""}, (3, 3), "expert_event_empty"), "outside": ({"source_path": "raw/crypto_archive/../other/p.md"}, (3, 3), "source_path_outside"),
        "absolute": ({"source_path": "/raw/crypto_archive/posts/p.md"}, (3, 3), "source_path_outside"), "above": ({"source_path": "../raw/crypto_archive/posts/p.md"}, (3, 3), "source_path_outside"), "image_out": ({"source_image_path": "raw/crypto_archive_2/a.png"}, (3, 3), "image_path_outside"),
        "no_post": ({"source_path": "raw/crypto_archive/posts/q.md"}, (3, 3), "source_path_not_there"), "no_image": (image("z.png"), (3, 3), "image_path_not_there"), "half": ({}, (3, None), "excerpt_not_lines"), "zero": ({}, (0, 3), "excerpt_order"), "turned": ({}, (3, 2), "excerpt_order"),
        "beyond": ({}, (3, 6), "excerpt_beyond_file"), "before": ({}, (1, 2), "image_not_referenced"), "other": (image("b.png"), (4, 5), "image_not_referenced"),
    }
    rows = [(name, *(({**good, **changes})[f] for f in FIELDS), place) for name, (changes, place, _) in cases.items()]
    posts = spark.createDataFrame([("raw/crypto_archive/posts/p.md", POST)], "path string, text string")
    images = spark.createDataFrame([(f"raw/crypto_archive/images/{x}.png",) for x in ("v/a", "b", "d")], "path string")
    got = {r.case_id: r.problem for r in ev.provenance_problems(spark.createDataFrame(rows, SCHEMA), posts, images).collect()}
    assert got == {name: want for name, (_, _, want) in cases.items()}
