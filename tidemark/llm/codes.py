"""Operator 11: vectors as codes of equal parts, the nearest entry found in a vantage-point tree.

Each part position has a codebook of integer entries.  Over a codebook stands a tree: an inner node holds
one entry as its vantage point and splits the rest at the median distance from it, and keeps the least and
greatest distance on either side.  A part descends by branch and bound: by the triangle inequality no entry
of a side is nearer than the gap between the part's own distance and the side's range.  Distances are square
roots of integers, so every bound is rounded outwards and a side is entered unless its bound is truly above
the best distance so far; entries are compared by their exact integer squares, and at equal squares the
lower index wins.  Searches run on all parts of a batch at once; a node splits them by the side to enter first.

Rounds are Spark jobs: tasks assign their vectors and add them up by part and entry, the sums are added by
a shuffle of at most one row for each part, entry and task, and only the codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, sized_broadcast

#: Entries that a leaf compares directly.
LEAF = 8
#: Vectors that are searched at once.
PIECE = 8192
#: Squared distances up to here are exact as doubles.
EXACT = 1 << 53


class Tree:
    """A vantage-point tree over the rows of an integer matrix."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.int64)
        self.root = self._node(np.arange(len(entries)))

    def _node(self, rows: np.ndarray) -> tuple:
        """("leaf", rows) or ("split", vantage, near, far); a side is (node, least, greatest distance), rounded outwards."""
        if len(rows) <= LEAF:
            return ("leaf", rows)
        # the entry furthest from the first one: vantage points at the rim separate best
        vantage = rows[int(np.argmax(_squares(self.entries[rows], self.entries[rows[0]])))]
        rest = rows[rows != vantage]
        squares = _squares(self.entries[rest], self.entries[vantage])
        order = np.argsort(squares, kind="stable")
        half = len(rest) // 2
        sides = []
        for part in (order[:half], order[half:]):
            root = np.sqrt(squares[part].astype(np.float64))
            sides.append((self._node(np.sort(rest[part])), _down(root.min()), _up(root.max())))
        return ("split", vantage, *sides)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``points`` the index of its nearest entry (ties: the lower one) and the squared distance."""
        points = points.astype(np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries))
        if len(points):
            self._visit(self.root, points, np.arange(len(points)), best, index)
        return index, best

    def _offer(self, rows: np.ndarray, points: np.ndarray, who: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Compare the points ``who`` with entries (ascending); the squared distances, entries x points."""
        own = points[who]
        squares = np.stack([_squares(own, self.entries[row]) for row in rows])
        first = squares.argmin(axis=0)  # the lowest of equal ones
        least, row = squares[first, np.arange(len(who))], rows[first]
        had = best[who]
        better = (least < had) | ((least == had) & (row < index[who]))
        won = who[better]
        best[won], index[won] = least[better], row[better]
        return squares

    def _visit(self, node: tuple, points: np.ndarray, who: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if node[0] == "leaf":
            self._offer(node[1], points, who, best, index)
            return
        _, vantage, *sides = node
        away = np.sqrt(self._offer(np.array([vantage]), points, who, best, index)[0].astype(np.float64))
        # the side whose range is closer is entered first
        gaps = [np.maximum(_down(away) - high, low - _up(away)) for _, low, high in sides]
        near_first = gaps[0] <= gaps[1]
        for group, order in ((near_first, (0, 1)), (~near_first, (1, 0))):
            for k in order:
                # not strict: a side at just the best distance may hold an equal entry of a lower index
                open_ = group & (_down(gaps[k]) <= _up(np.sqrt(best[who].astype(np.float64))))
                if open_.any():
                    self._visit(sides[k][0], points, who[open_], best, index)


def _squares(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    away = points - point
    return np.einsum("ij,ij->i", away, away)


def _up(x):
    return np.nextafter(x, np.inf)


def _down(x):
    return np.nextafter(x, -np.inf)


def quantised(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, q): ``q`` is floor(scale * component) as longs; vectors that are null or hold a null or non-finite component go."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    sound = F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    slim = vectors.where(sound).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))
    return slim


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids (equal ids by components, null ids last)."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()  # at most ``entries`` rows
    lengths = {len(r["q"]) for r in rows}
    if len(lengths) > 1 or any(n == 0 or n % parts for n in lengths):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    width = next(iter(lengths), parts) // parts
    return np.array([r["q"] for r in rows], dtype=np.int64).reshape(len(rows), parts, width).transpose(1, 0, 2)


def _matrix(column: pa.ListArray, books: np.ndarray) -> np.ndarray:
    """The vectors of a batch, vectors x parts x width."""
    parts, _, width = books.shape
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * parts * width or not np.array_equal(np.diff(column.offsets.to_numpy()), np.full(len(column), parts * width)):
        raise ValueError(f"vectors must have one length, here {parts * width}")
    reach = int(max(np.abs(flat).max(initial=0), np.abs(books).max(initial=0)))
    if (2 * reach) ** 2 * width >= EXACT:
        raise ValueError("components are too large for exact distances")
    return flat.astype(np.int64).reshape(len(column), parts, width)


def _searched(books: np.ndarray, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the batches with their vectors, codes (vectors x parts) and squared distances."""
    trees = [Tree(b) for b in books]
    for whole in batches:
        for k in range(0, whole.num_rows, PIECE):
            piece = whole.slice(k, PIECE)
            x = _matrix(piece.column(at), books)
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees)]
            yield piece, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """Sums and counts by part and entry of the vectors assigned to it, added up in each task first."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, x, codes, _ in _searched(books, batches, 0):
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p], codes[:, p], x[:, p])
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    each = kept.select("q").mapInArrow(run, "part int, entry int, n long, total array<long>")
    long = each.select("part", "entry", "n", F.posexplode("total").alias("place", "v"))
    return long.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))


def trained(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """The codebooks after ``rounds`` rounds of assigning and averaging (floor of the mean); entries without vectors stay."""
    books = first_codebooks(kept, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        rows = _sums(kept, books).collect()  # one row for each number of the codebooks
        books = books.copy()
        for r in rows:
            books[r["part"], r["entry"], r["place"]] = int(r["v"]) // r["n"]
    return books


def encoded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``kept`` with ``codes`` (the nearest entry of each part) and ``error`` (squared distances, summed), without ``q``."""
    names = ["vec_id", "label"]
    schema = T.StructType([*(kept.schema[c] for c in names), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, codes, squares in _searched(books, batches, 2):
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), listed, pa.array(squares.sum(axis=1), pa.int64())], names=[*names, "codes", "error"])

    return kept.select(*names, "q").mapInArrow(run, schema)


def book_text(books: np.ndarray) -> str:
    """All numbers of the codebooks by part, entry and place, joined by commas."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def hex_code(codes: Column) -> Column:
    """Codes as two hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Train codebooks on all sound vectors and encode them: ((vec_id, label, codes, error, label_error), codebooks).

    ``label_error`` is the sum of ``error`` over equal labels, nulls together.  Vectors that are null or hold
    null or non-finite components give no row; an empty table gives none and empty codebooks.  With fewer
    vectors than entries the codebooks are as short.  Repeated rows are separate vectors; equal ids rank by
    their components, null ids last.  Other columns are not read.  Vectors of another length than the first,
    a length that parts don't divide, and components beyond exact distances raise ValueError.
    """
    kept = quantised(vectors, scale, vec_id, vector, label)
    books = trained(kept, parts, entries, rounds)
    coded = Tables(vectors.sparkSession).write("codes", encoded(kept, books))
    sums = sized_broadcast(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(book_text(books).encode()).hexdigest()
