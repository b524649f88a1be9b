"""Bars from a client that is asked for one symbol at a time, as a Spark data source.

Every symbol is a partition of its own, so symbols are fetched side by side, as many at once as there are
task slots, and lost tasks are fetched again.  A symbol that can't be fetched gives one row with its error in
place of bars; the others are not touched by it.  Filters on the symbol choose what is fetched at all.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from typing import Any, Protocol
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.symbols import normalize_timeframe
from ..operators import rules
from .bars import KLINE, check_limit

SCHEMA = "symbol string, timeframe string, open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, trades bigint, error string"
#: Fixed value: what a scan says of a symbol that could not be fetched.
FAILED = "data fetch failed: "
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Client(Protocol):
    def get_ohlcv(self, symbol: str, timeframe: str, limit: int) -> list[list[Any]]:
        """Rows of an exchange, oldest first: at least nine fields each, in the order of ``KLINE``."""


class SavedRows:
    """A client of saved rows: JSON arrays by line in files of ``folder/symbol=SYMBOL``."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def get_ohlcv(self, symbol: str, timeframe: str, limit: int) -> list[list[Any]]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        at = f"{top.rstrip('/')}/symbol={quote(symbol, safe='')}"
        if store.get_file_info(at).type == fs.FileType.NotFound:
            raise LookupError(f"unknown symbol {symbol}")
        files = [f.path for f in store.get_file_info(fs.FileSelector(at)) if not f.base_name.startswith(("_", "."))]
        rows = [json.loads(line) for f in sorted(files) for line in store.open_input_stream(f).read().decode().splitlines() if line.strip()]
        return sorted(rows, key=lambda r: int(r[0]))[-limit:]


class _Symbol(InputPartition):
    def __init__(self, symbol: str) -> None:
        super().__init__(symbol)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.symbols = list(dict.fromkeys(json.loads(options["symbols"])))
        self.timeframe, self.limit = normalize_timeframe(options["timeframe"]), check_limit(int(options.get("limit", "200")))
        self.client, self.settings = options["client"], json.loads(options.get("settings", "{}"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = [s for s in self.symbols if s in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in self.symbols] or [_Symbol("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        symbol = partition.value
        if symbol == "":
            return
        module, name = self.client.split(":")
        try:
            client: Client = getattr(importlib.import_module(module), name)(**self.settings)
            rows = [self._bar(symbol, r) for r in client.get_ohlcv(symbol, self.timeframe, self.limit)]
        except Exception as e:  # noqa: BLE001  any failure of a client is this symbol's row
            yield (symbol, self.timeframe, *[None] * len(KLINE), f"{type(e).__name__}: {e}")
            return
        yield from rows

    def _bar(self, symbol: str, row: list[Any]) -> tuple:
        if len(row) < len(KLINE):
            raise ValueError(f"a row of {len(row)} fields")
        return (symbol, self.timeframe, *((int if kind == "bigint" else float)(row[at]) for _, at, kind in KLINE), None)


class FetchedBars(DataSource):
    """``spark.read.format("fetched_bars")``; options: symbols (a JSON list), timeframe, limit, client (``module:Class``) and settings (its arguments, JSON)."""

    @classmethod
    def name(cls) -> str:
        return "fetched_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def fetched_bars(spark: SparkSession, symbols: list[str], timeframe: str, limit: int, client: str, **settings: Any) -> DataFrame:
    """H-04: bars, and errors, of symbols; nothing is fetched before the rows are asked for, and again each time they are."""
    spark.dataSource.register(FetchedBars)
    spark.conf.set(PUSHDOWN, "true")
    options = {"symbols": json.dumps(symbols), "timeframe": timeframe, "limit": str(limit), "client": client, "settings": json.dumps(settings)}
    return spark.read.format("fetched_bars").options(**options).load()


def scan_fetched(spark: SparkSession, symbols: list[str], timeframe: str, rule: str, client: str, reference: str | None = None, **settings: Any) -> DataFrame:
    """R-07 over a client: symbol, position, match, reason, score for each of ``symbols``; one that failed doesn't match and says why.

    The rows are kept once fetched, in memory and on disk, as bars and errors are both read from them.
    """
    if not symbols:
        raise ValueError("symbols must not be empty")
    timeframe = normalize_timeframe(timeframe)
    asked = [*symbols, *([reference] if rule == rules.RELATIVE_STRENGTH and reference and reference not in symbols else [])]
    limit = rules.fetch_limit(rules.required_bars(rule, timeframe)) if rule in rules.RULES or rule == rules.RELATIVE_STRENGTH else 1
    got = fetched_bars(spark, asked, timeframe, limit, client, **settings).cache()
    if rule == rules.RELATIVE_STRENGTH and (lost := got.where((F.col("symbol") == reference) & F.col("error").isNotNull()).select("error").take(1)):
        raise ValueError(f"relative strength needs its reference: {lost[0]['error']}")
    listed = spark.createDataFrame(list(enumerate(symbols)), "position int, symbol string")
    found = rules.evaluate(got.where("error is null").drop("error"), listed, timeframe, rule, reference)
    errors = got.where("error is not null").select("symbol", "error")
    out = found.join(errors, "symbol", "left")
    failed = F.col("error").isNotNull()
    return out.select("symbol", "position", (F.col("match") & ~failed).alias("match"), F.when(failed, F.concat(F.lit(FAILED), "error")).otherwise(F.col("reason")).alias("reason"), F.when(failed, 0.0).otherwise(F.col("score")).alias("score"))
