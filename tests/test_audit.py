"""The audit over a small corpus with one case of each control, and its report."""

from __future__ import annotations

from tidemark.operators import audit

PROSE = "The market had been drifting sideways for many weeks while large interests absorbed the floating supply without any haste."
RAW = {
    **{f"raw/book/pages/page_{n:03d}.md": PROSE + f"\n\nPage {n} goes on in the same manner." for n in (108, 111, 141, 142, 145, 146, 147, 149)},
    "raw/book/pages/page_144.md": PROSE + "\n\nSECOND PART OF THE RANGE",
    "raw/book/pages/page_163.md": "![one](a.png)\n\n![two](b.png)\n",
}
LISTED = (141, 163, 144, 145, 146, 147, 149, 142)
PAGE = (
    "---\ntitle: T\nsources:\n" + "".join(f"  - path: raw/book/pages/page_{n}.md\n    note: n\n" for n in LISTED) + "---\n\n# Head\n\n"
    "Strict ([book p.141](../../../raw/book/pages/page_141.md)):\n\n> A rally of this kind must lead out of the range at once, and whatever\n> falls short of that is no more than a test.\n\n"
    'Right:\n\n> "The market had been drifting sideways for some weeks while large interests absorbed\n> the floating supply." — [book p.149](../../../raw/book/pages/page_149.md)\n\n'
    "Own words:\n\n> **Synthesis:** labels stay provisional until the structure\n> resolves ([book p.142](../../../raw/book/pages/page_142.md)).\n\n"
    "A range ([book p.144–147](../../../raw/book/pages/page_144.md)).\n\nTwo pages ([book p.108, p.111](../../../raw/book/pages/page_108.md)).\n\nNone ([book p.999](../../../raw/book/pages/page_999.md)).\n"
)


def tables(spark, files, raw):
    make = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    return make(files), make(raw)


def test_controls(spark):
    files, raw = tables(spark, {"knowledge/wiki/events/x.md": PAGE}, RAW)
    found = audit.in_order(audit.issues(files, raw)).collect()
    page = lambda n: f"raw/book/pages/page_{n:03d}.md"
    want = {
        ("frontmatter_missing", page(108)), ("frontmatter_missing", page(999)), ("image_only", page(163)), *(("inline_missing", page(n)) for n in (145, 146, 147, 163)),
        ("missing_raw", page(999)), ("quote_not_found", page(141)), ("range_missing_frontmatter", page(108)), ("section_boundary", page(144)),
    }
    assert {(x.code, x.raw_path) for x in found} == want and len(found) == len(want)
    said = {(x.code, x.raw_path): x for x in found}
    assert said["range_missing_frontmatter", page(108)].detail.endswith(f"{page(108)}, {page(111)}")
    assert said["quote_not_found", page(141)].detail.endswith("'rally of this kind must lead out of the range at once'")
    assert said["section_boundary", page(144)].citation == page(144)  # the listed source; the range goes on
    assert said["missing_raw", page(999)].citation == "book p.999" and said["missing_raw", page(999)].severity == "HARD"
    assert [(x.file, x.line, x.code) for x in found] == sorted((x.file, x.line, x.code) for x in found)


def test_report(spark):
    files, raw = tables(spark, {"knowledge/wiki/events/x.md": PAGE, "knowledge/wiki/health/r.md": PAGE, "knowledge/wiki/clean.md": "# Nothing\n"}, RAW)
    kept = audit.auditable(files, "knowledge/wiki/")
    found = audit.issues(kept, raw)
    r = audit.report(kept, found).first().asDict()
    assert (r["files_checked"], r["files_with_flags"], r["total_flags"], r["hard_flags"], r["warning_flags"]) == (2, 1, 11, 6, 5)
    assert r["summary_by_severity"] == {"HARD": 6, "WARNING": 5} and r["summary_by_code"]["inline_missing"] == 4 and sum(r["summary_by_code"].values()) == 11
    assert audit.exit_code(found) == 1
    none = kept.where("path like '%clean.md'")
    empty = audit.issues(none, raw)
    assert audit.exit_code(empty) == 0 and audit.report(none, empty).first().total_flags == 0


def test_repeats_and_missing_targets(spark):
    page = "---\nsources:\n  - path: raw/a.md\n---\nOne [p. 5-6](raw/book/pages/page_007.md) and [p. 5-6](raw/book/pages/page_007.md), [a](raw/a.md), [a again](raw/a.md).\n\n> it's six words \"long\" or more here\n> ([a](raw/a.md))\n\n> 1 2 3 4 5 6 7\n> ([a](raw/a.md))\n"
    files, raw = tables(spark, {"x.md": page}, {"raw/a.md": "![i](i.png)", "raw/book/pages/page_005.md": PROSE})
    found = audit.issues(files, raw).collect()
    seen = sorted((x.line, x.code, x.citation) for x in found)
    assert seen == sorted([
        (3, "image_only", "raw/a.md"), (5, "image_only", "a"), (5, "missing_raw", "p. 5-6"), (5, "frontmatter_missing", "p. 5-6"), (5, "range_target", "p. 5-6"), (5, "range_missing_raw", "p. 5-6"), (5, "range_missing_frontmatter", "p. 5-6"),
        (7, "quote_not_found", "a"), (8, "image_only", "a"), (11, "image_only", "a"),
    ])
    assert next(x.detail for x in found if x.code == "quote_not_found").endswith("\"it's six words long or more here\"")
