"""Operator 13: document fingerprints by winnowing.

Every run of ``k`` code points (a gram) is hashed; of each ``w`` consecutive grams the least hash is kept,
of equal ones the rightmost, together with its place.  Two texts that share ``k + w - 1`` code points in a
row share the kept gram of that window, so such a match is never missed; grams shorter than ``k`` are never
matched but for texts that are shorter themselves, which are one gram.

A polynomial hash of a gram is put together from hashes of its halves, so all grams of a piece take a few
passes of an array; window minima are put together the same way.  Long texts go by pieces that overlap by
one window, so memory is bounded by the piece.

For each document the next one by id is needed.  Rows are dealt to ranges of ids whose bounds are rows of
a sample; the row at a range's bound is also the last one that the range before it reads, so every range
is worked through in order by itself, with one document in hand and one to come.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, free_name

#: Code points of a gram, and grams of a window: 50 code points in a row are always found.
GRAM, WINDOW = 12, 39
#: Code points that are hashed at once.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all runs of ``k`` code points: a polynomial modulo 2^64, then mixed."""
    h, size = points.astype(np.uint64) + np.uint64(1), 1
    for bit in bin(k)[3:]:  # from the leading bit down: double the run, then add a code point where the bit is set
        factor = np.uint64(pow(_BASE, size, 1 << 64))
        h, size = h[: len(h) - size] * factor + h[size:], 2 * size
        if bit == "1":
            h, size = h[:-1] * np.uint64(_BASE) + (points[size:].astype(np.uint64) + np.uint64(1)), size + 1
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(32)).astype(np.uint32)


def _window_picks(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of every ``w`` in a row, the rightmost of equal ones; each place once, ascending."""
    w = min(w, len(hashes))
    # one number orders by hash and then by place from the right
    best, size = (hashes.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64)), 1
    while size < w:
        step = min(size, w - size)
        best, size = np.minimum(best[: len(best) - step], best[step:]), size + step
    return np.unique(np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)


def fingerprint(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the kept grams of a text, in order; a shorter text than a gram is one gram, no text has none."""
    points = code_points(text)
    if len(points) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    k = min(k, len(points))
    places, hashes = [], []
    step = max(PIECE, 2 * (k + w))
    for start in range(0, max(len(points) - (k + w - 1), 0) + 1, step):
        # the windows that begin in this piece
        found = gram_hashes(points[start : start + step + k + w - 2], k)
        kept = _window_picks(found, w)
        places.append(kept + start)
        hashes.append(found[kept])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the sets of hashes; 1 if both are empty."""
    x, y = np.unique(a), np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by as much of the beginning of the next document."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``places`` and ``hashes``, the kept grams of each text, in order.

    Null and empty texts have none; repeated rows are separate documents with equal fingerprints; an empty
    table gives no rows.  Other columns pass through, also those named like the new ones, which are replaced.
    """
    schema = T.StructType([T.StructField("places", T.ArrayType(T.LongType())), T.StructField("hashes", T.ArrayType(T.LongType()))])

    @F.pandas_udf(schema)
    def each(texts: pd.Series) -> pd.DataFrame:
        found = [fingerprint(t or "", k, w) for t in texts]
        return pd.DataFrame({"places": [p for p, _ in found], "hashes": [h.astype(np.int64) for _, h in found]})

    got = free_name(docs, of="_kept")
    return docs.withColumn(got, each(F.col(text))).withColumns({"places": F.col(f"{got}.places"), "hashes": F.col(f"{got}.hashes")}).drop(got)


def _order_key(docs: DataFrame, key: str, text: str) -> Column:
    """A string that sorts as: null ids, then ids ascending; equal ids by the MD5 of their text; equal rows by a serial."""
    if isinstance(docs.schema[key].dataType, T.StringType):
        spelt = F.lower(F.hex(F.encode(F.col(key), "UTF-8")))
    else:  # sixteen hex digits with the sign bit turned, so that negative ids come first
        spelt = F.lower(F.lpad(F.hex(F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    serial = F.lpad(F.hex(F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))), 4, "0")
    return F.concat(F.when(F.col(key).isNull(), F.lit(" ")).otherwise(F.concat(F.lit("/"), spelt)), F.lit("!"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), serial)


#: Sampled rows for each range; their texts are written once, their keys reach the driver.
SAMPLED = 8
#: Most ranges; beyond that ranges grow.
MOST_RANGES = 20_000


def in_id_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, range, head, at): rows dealt to ranges of ids, to be sorted in a range by head and then ``at``.

    ``head`` marks a copy of the row that follows the range's last one: the first row of the next range,
    and the first of all rows for the last range.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), _order_key(docs, key, text).alias("at"))
    ranges = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    all_ = slim.agg(F.count("*").alias("n"), F.min(F.struct("at", "id", "text")).alias("first"))
    row = all_.first()
    n, first = row["n"], row["first"]
    share = min(1.0, SAMPLED * ranges / max(n, 1))
    sample = Tables(spark).write("sample", slim.sample(share, 13))
    known = sorted(r["at"] for r in sample.select("at").collect())  # bounded: SAMPLED keys a range
    bounds = sorted({known[i * len(known) // ranges] for i in range(1, ranges)} - {first["at"] if first else ""}) if known else []

    @F.pandas_udf("int")
    def placed(at: pd.Series) -> pd.Series:
        return at.map(lambda x: bisect_right(bounds, x)).astype("int32")

    body = slim.select("id", "text", placed("at").alias("range"), F.lit(0).alias("head"), "at")
    heads = sample.where(F.col("at").isin(bounds)).dropDuplicates(["at"]).select("id", "text", (placed("at") - 1).alias("range"), F.lit(1).alias("head"), "at")
    last = all_.where("n > 0").select(F.col("first.id").alias("id"), F.col("first.text").alias("text"), F.lit(len(bounds)).alias("range"), F.lit(1).alias("head"), F.col("first.at").alias("at"))
    return body.unionByName(heads).unionByName(last)


def compared(docs: DataFrame, k: int = GRAM, w: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text, and how alike they and the next document's are.

    Returns (id, n_chars, edited_sha256, places, hashes, edited_places, edited_hashes, near_edited, near_next).
    The edited text has its last quarter replaced by the beginning of the next document in ascending id;
    null ids come first, equal ids by the MD5 of their text, and after the last comes the first, so a single
    document is its own next.  Null texts count as empty; two empty fingerprints have a likeness of 1.
    An empty table gives no rows; other columns are not read.
    """
    dealt = in_id_order(docs, key, text)
    schema = T.StructType([
        T.StructField("id", docs.schema[key].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("places", T.ArrayType(T.LongType())), T.StructField("hashes", T.ArrayType(T.LongType())),
        T.StructField("edited_places", T.ArrayType(T.LongType())), T.StructField("edited_hashes", T.ArrayType(T.LongType())), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        out: list[tuple] = []
        held = None  # range, id, text, fingerprint
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                id_, body, of, head = (batch.column(c)[i].as_py() for c in range(4))
                body = body or ""
                if held is not None and held[0] == of:
                    mine, changed = held[2], edited(held[2], body)
                    (p, h), (ep, eh), (np_, nh) = held[3], fingerprint(changed, k, w), fingerprint(body, k, w)
                    out.append((held[1], len(mine), hashlib.sha256(changed.encode()).hexdigest(), p, h.astype(np.int64), ep, eh.astype(np.int64), likeness(h, eh), likeness(h, nh)))
                    size += len(mine)
                    held = None if head else (of, id_, body, (np_, nh))
                else:  # the first row of a range
                    held = None if head else (of, id_, body, fingerprint(body, k, w))
                if size > 1 << 21:
                    yield _batch(out, arrow)
                    out, size = [], 0
        if out:
            yield _batch(out, arrow)

    of = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(of, "range").sortWithinPartitions("range", "head", "at").select("id", "text", "range", "head").mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def spelt(places: Column, hashes: Column) -> Column:
    """A fingerprint as a string: place and hash (eight hex digits) of each kept gram, comma-joined."""
    return F.array_join(F.zip_with(places, hashes, lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(h), 8, "0")))), ",")
