"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, return.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset on one machine, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    made = spark.sparkContext.getCheckpointDir()
    if made:
        return made.rsplit("/", 1)[0]
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-checkpoints-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable, eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Folders of the tables written so far; ``clear_tables`` drops them.
_MADE: list[str] = []


class Tables:
    """Tables written to the shared folder to cut lineage; compressed, read by column, and dropped once later ones stand."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top = spark, f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        _MADE.append(self.top)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = f"{self.top}/{name}"
        df.write.parquet(path)
        # the shuffles that led here are not read again; Spark deletes their files once the driver has collected what names them
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.paths.pop(name))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def clear_tables(spark: SparkSession) -> int:
    """Drop every table that operators have written from this process, how many folders there were; results that still read them are lost."""
    n = len(_MADE)
    while _MADE:
        _delete(spark, _MADE.pop())
    return n


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; null text: empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_RUN), "")


def word_count(text: Column) -> Column:
    """How many words ``word_array`` would give (null: 0)."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WS_RUN))).cast("long")


#: Rows that are Python objects at once; a batch's columns are turned into lists piece by piece.
PIECE_ROWS = 512


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows; what Arrow has kept for itself is given back when they end."""
    for b in batches:
        yield from (b.slice(k, PIECE_ROWS) for k in range(0, b.num_rows, PIECE_ROWS))
    pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, columns: list[str], schema: str | T.StructType, fn: Callable[..., Callable[[dict[str, list]], dict[str, list]]], *args) -> DataFrame:
    """Give pieces of the Arrow batches of ``columns`` to ``fn(*args)``'s result, as lists; it returns lists by output column."""
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn(*args)
        for b in _pieces(batches):
            got = each({c: b.column(i).to_pylist() for i, c in enumerate(columns)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, struct)


def filter_batches(df: DataFrame, columns: list[str], fn: Callable[..., Callable[[dict[str, list]], list[bool]]], *args) -> DataFrame:
    """The rows of ``df`` for which ``fn(*args)``'s result says so, given ``columns`` as lists; other columns pass as Arrow, untouched."""
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = fn(*args)
        for b in _pieces(batches):
            yield b.filter(pa.array(keep({c: b.column(i).to_pylist() for c, i in zip(columns, at, strict=True)}), pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: Rows of a key and a number (some 30 MB) that are sent to every task; more are joined by shuffle.
FEW_ROWS = 1_000_000


def sized_broadcast(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def field_ddl(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def free_name(*frames: DataFrame, of: str) -> str:
    """``of``, lengthened until no column of ``frames`` has that name (in either case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while of.lower() in taken:
        of += "_"
    return of


def result_name(name: str, *results: str) -> str:
    """The name under which a key comes out beside an operator's own columns: its own, lengthened where one of them has it."""
    while name.lower() in {r.lower() for r in results}:
        name += "_"
    return name
