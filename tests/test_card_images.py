"""Images of cards against files, manifests and posts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.operators import evidence

BOOK, CRYPTO, FRASER = "raw/book/pages/page_012.md", "raw/crypto_archive/posts/p.md", "raw/bruce_fraser/posts/q.md"


def test_findings(spark):
    rows = {
        "none": ("Bez Slike", CRYPTO, "", "", {"image_none"}), "empty": ("", CRYPTO, "", "", set()), "absolute": ("/raw/i/a.png", CRYPTO, "", "", {"image_absolute"}), "missing": ("raw/i/z.png", CRYPTO, "", "", {"image_missing"}), "above": ("../a.png", CRYPTO, "", "", {"image_missing"}),
        "shown": ("raw/crypto_archive/i/a.png", CRYPTO, "", "", set()), "not_shown": ("raw/i/b.png", CRYPTO, "", "", {"image_provenance"}), "other_kind": ("raw/i/b.png", "notes.md", "", "", set()),
        "page": ("raw/i/b.png", BOOK, "12", "", set()), "range": ("raw/i/b.png", BOOK, "12", "12-13", set()), "bad_range": ("raw/i/b.png", BOOK, "12", "12-14", {"page_range_reach", "image_provenance"}), "other_page": ("raw/i/b.png", BOOK, "13", "", {"image_provenance"}), "no_page": ("raw/i/b.png", BOOK, "x", "", {"image_provenance"}), "unlisted": ("raw/i/c.png", BOOK, "12", "", {"image_provenance"}),
        "mapped": ("raw/i/c.png", FRASER, "", "", set()), "unmapped": ("raw/i/b.png", FRASER, "", "", {"image_provenance"}), "remote": ("(remote: http://h/x.png)", FRASER, "", "", set()), "remote_other": ("(remote: http://h/y.png)", FRASER, "", "", {"image_provenance"}), "remote_crypto": ("(remote: http://h/x.png)", CRYPTO, "", "", {"image_provenance"}), "remote_bad": ("(remote x)", FRASER, "", "", {"image_provenance"}),
    }
    cards = spark.createDataFrame([(n, {"image_path": i, "source": s, "page": p, "page_range": r}) for n, (i, s, p, r, _) in rows.items()], "path string, fields map<string,string>")
    files = spark.createDataFrame([(f"raw/i/{x}.png",) for x in "abc"] + [("raw/crypto_archive/i/a.png",)], "path string")
    book = spark.createDataFrame([("raw/i/b.png", 12), ("raw/i/a.png", 12)], "image_path string, page_number int")
    posts = spark.createDataFrame([(CRYPTO, "![x](../i/a.png) ![y](http://h/b.png)")], "path string, text string")
    pairs = lambda *x: spark.createDataFrame(list(x), "key string, post string")
    found = evidence.card_image_findings(cards, files, book, posts, pairs(("raw/i/c.png", FRASER), ("raw/i/b.png", "raw/bruce_fraser/posts/r.md")), pairs(("http://h/x.png", FRASER)))
    got = {n: set() for n in rows}
    for r in found.withColumn("n", F.count("*").over(W.Window.partitionBy("path", "code"))).collect():
        assert r.n == 1
        got[r.path].add(r.code)
    assert got == {n: want for n, (*_, want) in rows.items()}
